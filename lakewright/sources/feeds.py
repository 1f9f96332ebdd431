"""Raw feeds as DataFrames: JSON lines, envelopes, archives, wikitext, semantic answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.functions.text import plain_wikitext

c = F.col


def json_lines(spark: SparkSession, path: str, schema: str | None = None, langs: list[str] | None = None) -> DataFrame:
    """Lines of (gzipped) JSON, blank ones skipped. langs: kept by their first "lang", before any parsing."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if langs is not None:
        lines = lines.where(F.regexp_extract("value", '"lang"\\s*:\\s*"([^"]+)"', 1).isin(langs))
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*") if schema else lines


def write_chunks(lines: DataFrame, path: str, per_file: int, keep: Column | None = None) -> None:
    """Lines that meet a condition, in files of at most per_file lines."""
    kept = lines if keep is None else lines.where(keep)
    kept.write.option("maxRecordsPerFile", per_file).option("compression", "gzip").mode("overwrite").text(path)


def envelope(bodies: DataFrame, row: str, body: str = "value") -> DataFrame:
    """The results of JSON answers {success, errors, results}; one without success fails the job."""
    parsed = bodies.withColumn("_e", F.from_json(body, f"success boolean, errors array<string>, results array<struct<{row}>>"))
    said = F.concat(F.lit("the answer has no success: "), F.coalesce(F.array_join("_e.errors", "; "), F.left(body, F.lit(200))))
    checked = parsed.withColumn("_r", F.when(F.coalesce("_e.success", F.lit(False)), c("_e.results")).otherwise(F.raise_error(said).cast(f"array<struct<{row}>>")))
    return checked.select(*(x for x in bodies.columns if x != body), F.inline("_r"))


def data_array(spark: SparkSession, path: str, row: str) -> DataFrame:
    """The objects of a root object's `data` array. An answer without any fails the job."""
    whole = spark.read.option("multiLine", True).schema(f"data array<struct<{row}>>").json(path)
    rows = F.when(F.size("data") > 0, c("data")).otherwise(F.raise_error(F.lit("the answer is empty")).cast(f"array<struct<{row}>>"))
    return whole.select(F.inline(rows))


def archive(spark: SparkSession, root: str, row: str) -> DataFrame:
    """day, category, group and rows of a tree <day>/<category>/<group>/prices of envelopes."""
    part = lambda k: F.regexp_extract(c("_path"), r"([^/]+)/([^/]+)/([^/]+)/prices$", k)
    files = spark.read.option("wholetext", True).text(f"{root}/*/*/*/prices").select("value", c("_metadata.file_path").alias("_path"))
    keyed = files.select(part(1).cast("date").alias("day"), part(2).alias("category"), part(3).cast("int").alias("group"), "value")
    return envelope(keyed, row)


def has_day(daily: DataFrame, day: str, time: str = "observed_at") -> bool:
    return not daily.where(F.to_date(time) == F.lit(day).cast("date")).limit(1).isEmpty()


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def missing_days(spine: DataFrame, daily: DataFrame, time: str = "observed_at") -> DataFrame:
    """The days of a spine without rows yet: what a backfill still has to fetch."""
    return spine.join(daily.select(F.to_date(time).alias("day")).distinct(), "day", "left_anti")


def backfill_days(spine: DataFrame, landed: DataFrame, done: DataFrame, gaps: int = 3) -> DataFrame:
    """The landed days that a backfill takes, in order: those not done yet, before the first run of so many days without data.

    spine, landed and done have a column `day`; a spine has a day for each row, so its one partition is bounded by the calendar.
    """
    has = landed.select("day", F.lit(1).alias("_has")).distinct()
    w = Window.orderBy("day")
    marked = spine.join(has, "day", "left").withColumn("_has", F.coalesce("_has", F.lit(0)))
    empty = F.sum(1 - c("_has")).over(w.rowsBetween(1 - gaps, 0))
    stopped = marked.withColumn("_gap", (empty >= gaps).cast("int")).withColumn("_stop", F.max("_gap").over(w))
    return stopped.where("_has = 1 AND _stop = 0").join(done.select("day"), "day", "left_anti").select("day")


def landed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a landing folder of raw JSON lines; a folder that isn't there is one without rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).json(path) if held else spark.createDataFrame([], schema)


def keep_raw(bodies: DataFrame, path: str, body: str = "value") -> None:
    """A compressed copy of answers as they came, one a line, beside what is read from them."""
    bodies.select(body).write.mode("overwrite").option("compression", "gzip").text(path)


def effective_dates(dates: DataFrame, today: str) -> DataFrame:
    """Of each format, the newest date that isn't in the future."""
    return dates.where(c("date") <= F.lit(today).cast("date")).groupBy("format").agg(F.max("date").alias("date"))


def template_parts(body: str) -> list[str]:
    """A call's parts, split at bars outside nested calls and links."""
    parts, depth, last = [], 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", body):
        token = m.group()
        if token in ("{{", "[["):
            depth += 1
        elif token != "|":
            depth = max(0, depth - 1)
        elif not depth:
            parts.append(body[last : m.start()])
            last = m.end()
    return [*parts, body[last:]]


def template_calls(text: str | None, name: str) -> list[dict]:
    """Each call of a template: its named parameters (keys in lower case), and the lines of the others."""
    calls, at = [], 0
    begin = re.compile(r"\{\{\s*" + re.escape(name) + r"\s*\|", re.IGNORECASE)
    while text and (m := begin.search(text, at)):
        depth, end = 1, len(text)
        at = len(text)
        for brace in re.compile(r"\{\{|\}\}").finditer(text, m.end()):
            depth += 1 if brace.group() == "{{" else -1
            if not depth:
                end, at = brace.start(), brace.end()
                break
        named, lines = {}, []
        for part in template_parts(text[m.end() : end]):
            pair = re.match(r"\s*([\w$-]+)\s*=(.*)", part, re.DOTALL)
            if pair:
                named[pair[1].lower()] = pair[2].strip()
            else:
                lines += part.split("\n")
        calls.append({"named": list(named.items()), "lines": lines})
    return calls


def wikitext_calls(pages: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The other columns of pages with one row for each call: call (its place), named (a map), lines."""

    @F.pandas_udf("array<struct<named:array<struct<k:string,v:string>>,lines:array<string>>>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"named": [{"k": k, "v": v} for k, v in x["named"]], "lines": x["lines"]} for x in template_calls(t, name)] for t in texts])

    rest = [x for x in pages.columns if x != text]
    calls = pages.select(*rest, F.posexplode(parsed(c(text))).alias("call", "_c"))
    return calls.select(*rest, "call", F.map_from_entries("_c.named").alias("named"), c("_c.lines").alias("lines"))


def set_list_codes(pages: DataFrame, text: str = "text") -> DataFrame:
    """The printed codes of the rows of set lists."""
    calls = wikitext_calls(pages, "Set list", text)
    rest = [x for x in pages.columns if x != text]
    rows = calls.select(*rest, "call", F.posexplode("lines").alias("line", "_l")).withColumn("code", F.trim(F.regexp_extract("_l", r"^(.*?)(;|//|$)", 1)))
    return rows.where(c("code").rlike(r"^[A-Za-z0-9]+-[A-Za-z0-9]+$")).select(*rest, "call", "line", "code")


#: Language of a gallery's region.
REGIONS = {"EN": "en", "NA": "en", "EU": "en", "AU": "en", "OC": "en", "DE": "de", "FR": "fr", "FC": "fr", "IT": "it", "SP": "es", "PT": "pt"}


#: How the wiki names galleries, and what it leaves out of file names.
GALLERY_TITLE = r"^Set Card (?:Galleries|Lists):(.+) \(TCG-([A-Z]+)(?:-([A-Z0-9]+))?\)$"
NOT_IN_FILE_NAMES = "[ #,.:'\"?!&@%=\\[\\]<>/☆★・-]"


def gallery_titles(pages: DataFrame, title: str = "title") -> DataFrame:
    """pages with set, region, edition and lang of titles "… :<set> (TCG-<region>[-<edition>])"; others go."""
    part = lambda k: F.regexp_extract(c(title), GALLERY_TITLE, k)
    known = F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))
    out = pages.withColumn("set", part(1)).withColumn("region", part(2)).withColumn("edition", F.nullif(part(3), F.lit("")))
    return out.withColumn("lang", F.try_element_at(known, "region")).where("lang IS NOT NULL")


def image_name(name: Column) -> Column:
    """A card's name as it stands in file names."""
    bare = F.regexp_replace(F.regexp_replace(plain_wikitext(name), "#", ""), r"(?s)\s*\(.*$", "")
    return F.regexp_replace(bare, NOT_IN_FILE_NAMES, "")


def gallery_rows(pages: DataFrame, abbreviation, text: str = "text") -> DataFrame:
    """page columns, code, rarity, alt, file: the rows of galleries; pages have region and edition.

    abbreviation: a rarity's abbreviation as a function of its column; rows of unknown rarity go, and so do those
    without a number (abbr), a code or a name.
    """
    rest = [x for x in pages.columns if x != text]
    named = lambda k: F.nullif(F.try_element_at("named", F.lit(k)), F.lit(""))
    calls = wikitext_calls(pages, "Set gallery", text).where(named("abbr").isNull())
    calls = calls.withColumn("_region", F.coalesce(F.upper(named("region")), "region")).withColumn("_edition", F.coalesce(F.upper(named("edition")), "edition"))
    rows = calls.select("*", F.posexplode("lines").alias("line", "_l")).where(F.trim("_l") != "")
    rows = rows.withColumn("_values", F.transform(F.split(F.regexp_extract("_l", r"(?s)^(.*?)(//.*)?$", 1), ";"), lambda v: F.trim(v)))
    pairs = F.filter(F.transform(F.split(F.regexp_extract("_l", r"(?s)//(.*)$", 1), ";"), lambda o: F.split(o, "::")), lambda p: F.size(p) > 1)
    options = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    option = lambda k: F.nullif(F.get(F.filter(options, lambda o: o["k"] == k), F.lit(0))["v"], F.lit(""))
    value = lambda i: F.nullif(F.get("_values", F.lit(i)), F.lit(""))
    rows = rows.withColumn("code", value(0)).withColumn("_name", value(1)).withColumn("rarity", abbreviation(F.coalesce(value(2), named("rarity"), F.lit("Common")))).withColumn("alt", F.coalesce(value(3), named("alt"), F.lit("")))
    rows = rows.where("code IS NOT NULL AND _name IS NOT NULL AND rarity IS NOT NULL").where(option("abbr").isNull())
    stem = F.array_join(F.filter(F.array(image_name(c("_name")), F.regexp_replace(F.regexp_replace("code", "(?s)-.*$", ""), "/", ""), c("_region"), c("rarity"), c("_edition"), c("alt")), lambda x: x.isNotNull() & (x != "")), "-")
    file = F.coalesce(option("file"), F.concat(stem, F.lit("."), F.coalesce(option("extension"), F.lit("png"))))
    return rows.withColumn("file", file).select(*rest, "call", "line", "code", "rarity", "alt", "file")


#: The language names that start a wiki's properties.
WIKI_LANGUAGES = {"German": "de", "French": "fr", "Italian": "it", "Spanish": "es", "Portuguese": "pt"}


def wiki_answers(bodies: DataFrame, body: str = "value", languages: dict[str, str] = WIKI_LANGUAGES) -> DataFrame:
    """title, passwords, english_name, lang, name, text: the pages of answers, one row for each language they have."""
    parsed = F.from_json(body, "query struct<results:map<string,struct<printouts:map<string,array<string>>>>>")
    pages = bodies.select(F.explode(parsed["query"]["results"]).alias("title", "_r")).select("title", c("_r.printouts").alias("p"))
    first = lambda k: F.nullif(F.trim(F.get(F.try_element_at("p", F.lit(k)), F.lit(0))), F.lit(""))

    def text(prefix: str) -> Column:
        lore, pendulum = first(f"{prefix} lore"), first(f"{prefix} Pendulum Effect")
        head = F.when(lore.startswith("''"), "Flavor Text").otherwise("Monster Effect")
        both = F.concat(F.lit("[ Pendulum Effect ]\n"), plain_wikitext(pendulum), F.lit("\n\n[ "), head, F.lit(" ]\n"), plain_wikitext(lore))
        return F.coalesce(both, F.nullif(plain_wikitext(lore), F.lit("")))

    local = F.array(*(F.struct(F.lit(lang).alias("lang"), plain_wikitext(first(f"{prefix} name")).alias("name"), text(prefix).alias("text")) for prefix, lang in languages.items()))
    out = pages.select(
        "title",
        F.transform(F.coalesce(F.try_element_at("p", F.lit("Password")), F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")).alias("passwords"),
        plain_wikitext(first("English name")).alias("english_name"),
        F.inline(F.filter(local, lambda x: x["name"].isNotNull())),
    )
    return out
