"""URL rules against all rules one by one."""

import fnmatch
import random

import pytest
from oracle import difference, views

from lakewright.llm import url_filter as op


def fits(rule, url):
    """Whether a rule fits, told from its text alone."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in rest.split("/")[0])
    path = rest[len(rest.split("/")[0]) :]
    if rule.rank:
        name, slash, start = rule.text.partition("/")
        return (host == name or host.endswith("." + name)) and path.startswith(slash + start)
    if rule.joined:
        return fnmatch.fnmatchcase(host + path, rule.text)
    return any(x in SHOP for x in host.replace("-", ".").split(".")) if rule.host_alone else path.startswith("/x") and path[-1:].isdigit()


SHOP = {"shop"}


def brute(rules, url):
    return max((r for r in rules if fits(r, url)), key=op.precedence, default=None)


def random_rules(draw, n=80):
    rules = []
    for _ in range(n):
        host = ".".join(draw.choice(("a", "bb", "c-c", "shop", "com", "net")) for _ in range(draw.randint(1, 3)))
        path = "/" + draw.choice(("", "x", "x/", "x/y", "en/", "En/1"))
        rules.append(op.host_rule(draw.choice(("allow", "block")), host + path))
    lines = ["# comment", "", r"block re:(^|[.-])shop([.-]|$)", "block *.bb/x/*", "allow a.*com/en/1", "block c-c.*", "allow bb.com/x"]
    return rules + op.parse_rules(lines) + [op.pattern_rule("block", r"#/x.*[0-9]$")]


@pytest.mark.parametrize("max_rules", [1000, 7])
def test_index_finds_what_all_rules_find(spark, max_rules):
    draw = random.Random(5)
    rules = random_rules(draw)
    urls = [f"http{draw.choice(('', 's'))}://" + ".".join(draw.choice(("a", "bb", "c-c", "Shop", "com", "NET")) for _ in range(draw.randint(1, 4))) + draw.choice(("", "/", "/x", "/x/y?q#f", "/en/1", "#f", "?x/", "/En/12")) for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "a://b://c/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in op.url_filter(pages, rules, max_rules=max_rules).collect()}
    for k, url in enumerate(urls):
        want = brute(rules, url)
        shown = (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"], got[k]["pattern"])
        assert shown == (*op.split_url(url), want.text if want and want.rank else None, want.verdict if want else "allow", want.text if want and not want.rank else None), url


def test_rarest_token_files_a_rule():
    index = op.index_rules([op.host_rule("block", "www.com/"), op.host_rule("block", "rare.com/"), op.pattern_rule("block", ".*")])
    assert set(index) == {"www", "rare", ""}


def test_parse_rules():
    assert [(r.verdict, r.rank, r.tokens) for r in op.parse_rules(["block example.com", "allow */safe/pre*", "block re:^ads[.]"])] == [("block", 1, ("example", "com")), ("allow", 0, ("safe",)), ("block", 0, ())]
    with pytest.raises(ValueError, match="neither"):
        op.parse_rules(["drop x.org"])


def test_many_rules_are_compiled_when_fetched():
    matcher = op.Matcher(op.parse_rules(f"block host{k}.com/p{k}/" for k in range(50_000)))
    assert matcher.best("www.host77.com", "/p77/x").text == "host77.com/p77/" and sum(map(len, matcher.compiled.values())) == 1


def test_cases(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host string, rule string")
    assert op.url_filter(pages, op.production_rules()).count() == 0
    clash = spark.createDataFrame([(1, "http://x.NET/es/a", "mine", "mine"), (1, "http://x.NET/es/a", "mine", "mine")], "page_id long, url string, host string, rule string")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in op.url_filter(clash, op.production_rules()).collect()] == [("x.net", "/es/a", "net/es/", "block")] * 2
    assert op.url_filter(clash, []).first()["verdict"] == "allow"


def test_sql(spark, sf_dir):
    assert difference(spark, views(sf_dir), op.op3_url_filter, op.OP3_SQL, sf_dir) == ""


def test_expressions_are_compiled_as_given():
    matcher = op.Matcher([op.host_pattern_rule("block", r"a\$b"), op.host_pattern_rule("block", r"c$")])
    assert matcher.best("xa$b", "").verdict == "block" and matcher.best("xaZb", "") is None and matcher.best("abc", "").text == "c$"


def test_pattern_rules_read_the_host_alone(spark, tmp_path):
    urls = ["https://foo.casino/", "https://x.porn", "https://my-bets/x", "https://foo.org/how-ads-work", "https://foo.org/a.casino", "https://ads.foo.org/x", "https://bets?x", "https://a|casino|b/x", "http://a|b.com/x", "http://x|y.example.com/en/", "http://x|.net/es/", "http://|com/", "http://com/|x", "http://b.com|/x", "http://casino\n/x", "http://bets.\n/x", "http://n\net/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in op.op3_url_filter(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(8)] == ["block"] * 3 + ["allow"] * 2 + ["block"] * 2 + ["allow"]
    assert difference(spark, views(str(tmp_path)), op.op3_url_filter, op.OP3_SQL, str(tmp_path)) == ""
