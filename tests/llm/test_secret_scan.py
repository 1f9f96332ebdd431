"""Base patterns against a plain scan; the battery on random and ordinary strings."""

import hashlib
import random
import re
import string

import pytest
from oracle import difference, views

from lakewright.llm import secret_scan as op
from lakewright.llm.base import Scratch

PATTERNS = [
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile(r"()AKIA[A-Z0-9]+"), 0),
    ("hex", re.compile(r"()[0-9a-f]+"), 0),
]


def brute(text):
    out = []
    for order, (kind, pattern, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            whole = m.end() - m.start()
            if m.end(1) - m.start(1) >= least and whole >= {"assign": 0, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def random_texts(seed, n=120):
    draw = random.Random(seed)
    part = [
        lambda: draw.choice(("password", "PassWd", "secret", "Token", "apikey", "API_KEY", "tokens")) + draw.choice(("=", ": ", '" : "', "'='", " ", "==")) + "".join(draw.choice(string.ascii_letters + "+/_.=-") for _ in range(draw.randrange(1, 12))),
        lambda: "AKIA" + "".join(draw.choice(string.ascii_uppercase + string.digits) for _ in range(draw.randrange(12, 20))),
        lambda: "".join(draw.choice("0123456789abcdef") for _ in range(draw.randrange(20, 50))),
        lambda: draw.choice(("é ", "ſecret=abcdef1 ", "plain words ", "\n", "AKIA", "pass word=abcdefgh ", "😀")),
    ]
    return ["".join(draw.choice(part)() + draw.choice(("", " ", "-")) for _ in range(draw.randrange(0, 8))) for _ in range(n)]


def test_base_spans(spark, docs_of):
    texts = [*random_texts(1), None, ""]
    docs = docs_of(*texts)
    found = {r["doc_id"]: r for r in op.scan_secrets(docs, Scratch(spark, "t")).collect()}
    for k, t in enumerate(texts):
        got = [(op.KINDS[s["kind"]], s["start"], s["end"]) for s in sorted(found[k]["secrets"], key=lambda s: (s["start"], s["kind"])) if s["kind"] < 3]
        assert got == brute(t), t


def test_digest_counts_code_points(spark, tmp_path):
    text = "😀é password=hunter22 " + "0a" * 14
    spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op.op10_secret_scan(spark, str(tmp_path)).collect()}
    spans = "assign:3:20,hex:21:49"
    assert (rows[5]["n_assign"], rows[5]["n_access"], rows[5]["n_hex"], rows[5]["spans"]) == (1, 0, 1, spans)
    assert rows[5]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and rows[6]["spans"] == ""
    assert rows[6]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_the_battery_finds_random_keys_and_leaves_words(docs_of, spark):
    draw = random.Random(7)
    keys = ["".join(draw.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(60)]
    words = ["_".join(draw.choice(("load", "user", "table", "name", "count", "index", "the")) for _ in range(6)) for _ in range(300)]
    paths = [f"/srv/data/reports/{draw.randrange(2000, 2025)}/summary_final" for _ in range(300)]
    docs = docs_of(*[f"begin {x} end" for x in keys + words + paths])
    found = {r["doc_id"] for r in op.scan_secrets(docs, Scratch(spark, "t")).collect() if any(s["kind"] == 3 for s in r["secrets"])}
    assert sum(k in found for k in range(60)) >= 55 and not [k for k in found if k >= 60]


@pytest.mark.parametrize(("token", "encoding"), [("1234567890123456", "decimal"), ("deadbeef00112233", "hex"), ("ABCDEFGHIJKLMNOP", "one case"), ("abcxyz0123456789", "one case and digits"), ("abcXYZ0123456789", "alphanumeric"), ("ab+/ABCD01234567==", "base64")])
def test_encoding(token, encoding):
    assert op.randomness(token)[0] == encoding


@pytest.mark.parametrize("alphabet", [string.ascii_lowercase, string.ascii_letters + string.digits, "0123456789abcdef", string.digits])
def test_battery_is_calibrated(alphabet):
    """Of evenly drawn strings of any alphabet few are rejected; long ones of letters are unlike text."""
    draw = random.Random(11)
    drawn = [op.randomness("".join(draw.choice(alphabet) for _ in range(n)))[1:] for n in (20, 40, 300) for _ in range(300)]
    assert sum(even < op.REJECT for even, _ in drawn) <= 18
    if alphabet == string.ascii_lowercase:
        assert sorted(p for _, p in drawn[600:])[285] < 1e-6


def test_ordinary_words_are_like_text():
    draw = random.Random(12)
    syllables = "the an er in on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
    ps = sorted(op.randomness("".join(draw.choice(syllables) for _ in range(n)))[2] for n in (8, 12, 20) for _ in range(300))
    assert ps[9] > 1e-4


def test_fisher():
    assert op.fisher((1.0, 1.0, 1.0)) == 1.0 and abs(op.fisher((0.01,)) - 0.01) < 1e-12 and op.fisher((0.01, 0.01, 0.01)) < 1e-3 < op.fisher((0.01, 1.0, 1.0))


def test_tests_reject_what_is_not_random():
    assert op.randomness("abababababababababababababababab")[1] < op.REJECT
    assert op.randomness("AAAAAAAAAAAAAAAABBBBBBBBBBBBBBBB1111111122222222")[1] < op.REJECT


def test_values_after_equals_signs_and_long_runs_are_candidates(docs_of):
    draw = random.Random(3)
    drawn = lambda n: "".join(draw.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    assert [(m.start(), m.group()) for m in op.CANDIDATE.finditer("AWS_SECRET_ACCESS_KEY=abcdefghABCDEFGH0123== x")] == [(0, "AWS_SECRET_ACCESS_KEY"), (22, "abcdefghABCDEFGH0123==")]
    long = [drawn(n) for n in (600, 2_000, 20_000)]
    keys = [drawn(40) for _ in range(40)]
    texts = [f"KEY {x} end" for x in long] + [f"{name}={x}\n" for x in keys for name in ("GITHUB_PAT", "AWS_ACCESS_SECRET_KEY", "https://x.org/?sig")]
    out = [r["text"] for r in op.without_secrets(docs_of(*texts)).orderBy("doc_id").collect()]
    assert out[:3] == ["KEY <SECRET> end"] * 3
    # A few keys in a thousand look uneven to one of the tests.
    assert sum(x in t for x, t in zip([k for k in keys for _ in range(3)], out[3:], strict=True)) <= 9
    assert op.text_p(1_000_000, 500_000) == 0.0


def test_false_discovery_control():
    few = [(3, 100, 5)]
    assert op.thresholds(few)[3] == 5.0 and op.thresholds([(3, 10, 1000)])[3] == float("inf") and op.thresholds([])[0] == float("inf")
    # More chance finds lift the bar for the rest.
    assert op.thresholds([(0, 80, 1)])[0] == 4.0 and op.thresholds([(0, 80, 1), (0, 0, 10_000)])[0] == float("inf")


def test_redaction(docs_of):
    docs = docs_of("my password=hunter22 ok", None, "", "password=abcdefg0123456789abcdef0123")
    out = op.without_secrets(docs)
    assert out.columns == docs.columns
    assert [(r["text"], r["n_chars"]) for r in out.orderBy("doc_id").collect()] == [("my <SECRET> ok", 14), (None, None), ("", 0), ("<SECRET>", 8)]
    assert op.without_secrets(docs.limit(0)).count() == 0
    assert "n_chars" not in op.without_secrets(docs.drop("n_chars")).columns


def test_sql(spark, sf_dir):
    assert difference(spark, views(sf_dir), op.base_secret_counts, op.BASE_SQL, sf_dir) == ""
