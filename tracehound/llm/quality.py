"""Rule-based quality: statistics of each text, and line frequency across the documents of a host.

Everything is a column expression or a DataFrame operation. Words are runs of characters other than
ASCII white space; null texts have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, row_key, written

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # also a regex class
GRAM = 5


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    #: Per cent of words that may lie in repeated five-word windows.
    max_repeat: int = 20
    #: A line is boilerplate of its host when more documents than both limits hold it, or more than line_most however many the host has.
    line_docs: int = 20
    line_share: float = 0.1
    line_most: int = 40
    #: What has to be left once boilerplate lines are gone, in words and as per cent of all words.
    min_left: int = 10
    min_left_share: int = 20
    #: Lines known to be boilerplate are sent to every task up to this many, joined beyond.
    broadcast_lines: int = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN), lambda w: w != "")


def repeat_words(w: Column) -> Column:
    """Words of array w inside five-word windows that occur twice or more, first occurrence included."""

    def spread(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(GRAM)))
        return F.when(F.size(p) < 1, 0).otherwise(F.aggregate(gaps, F.lit(GRAM), lambda s, x: s + x))

    def twins(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return bind(F.array_sort(F.transform(again, lambda x: x["i"])), spread)

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bind(F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))
    return F.when(F.size(w) <= GRAM, F.lit(0)).otherwise(bind(grams, counted))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)


def base_stats(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select("doc_id", row_key().alias("key"), _host().alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    inside = bind(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r"), F.length(F.array_join(w, "")).cast("long").alias("c")))
    out = rows.select(
        "doc_id", "key", "host", inside.alias("w"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        bind(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("w.n") < rules.min_words) | (100 * F.col("w.r") > rules.max_repeat * F.col("w.n"))
    return out.select("doc_id", "key", "host", F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"), failed.alias("base_failed"))


def normal_line(line: Column) -> Column:
    """Lower case, no spaces at the ends."""
    return F.lower(F.btrim(line))


def _line_rows(docs: DataFrame, keep_line: bool) -> DataFrame:
    """The lines that hold a word; blank ones are no one's boilerplate."""
    lines = _lines(F.lower(F.coalesce("text", F.lit(""))))
    host = _host().alias("host")
    if not keep_line:  # each line once a document
        return docs.select(host, F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(F.btrim(x))))).alias("line_hash"))
    return docs.select("doc_id", row_key().alias("key"), host, F.monotonically_increasing_id().alias("row"), F.explode(lines).alias("line")).withColumn("line_hash", F.xxhash64(F.btrim("line")))


def _host() -> Column:
    return F.coalesce("source", F.lit(""))


def line_hits(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(host, line_hash, doc_id, key, row, n_words) of every line with a word that over its host's limits of documents hold.

    Rows with the same text and host count as one document. Lines in enough rows are found first,
    by counts that are summed within each task before they are shuffled, so no host or line is
    gathered in one place; only their occurrences are looked at again.
    """
    one = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    hosts = one.select("source", row_key().alias("k")).distinct().groupBy("source").agg(F.count("*").alias("docs"))
    many = lambda n: F.col(n) > F.least(F.greatest(F.lit(rules.line_docs), rules.line_share * F.col("docs")), F.lit(max(rules.line_docs, rules.line_most)))
    rows = _line_rows(one, False).groupBy("host", "line_hash").agg(F.count("*").alias("n")).where(F.col("n") > rules.line_docs)
    lines = written(rows.join(hosts, rows.host == hosts.source).where(many("n")).select("host", "line_hash", "docs"), "lines")
    small = lines.count() <= rules.broadcast_lines
    hits = written(_line_rows(one, True).join(F.broadcast(lines) if small else lines, ["host", "line_hash"]).select("host", "line_hash", "docs", "doc_id", "key", "row", F.size(words(F.col("line"))).alias("n_words")), "hits")
    texts = hits.select("host", "line_hash", "docs", "key").distinct().groupBy("host", "line_hash", "docs").agg(F.count("*").alias("texts"))
    often = texts.where(many("texts")).select("host", "line_hash")
    return hits.drop("docs").join(F.broadcast(often) if small else often, ["host", "line_hash"])


def depleted(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """d, k, h (doc_id, key and host), gone (words in frequent lines) and the lines' hashes, for documents with such lines.

    Equal rows give one.
    """
    name = [F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("host").alias("h")]
    rows = line_hits(docs, rules).groupBy(*name, "row").agg(F.sum("n_words").cast("long").alias("gone"), F.collect_set("line_hash").alias("hashes"))
    return rows.groupBy("d", "k", "h").agg(F.max("gone").alias("gone"), F.max("hashes").alias("hashes"))


def _with_lines(stats: DataFrame, gone: DataFrame) -> DataFrame:
    return stats.join(gone, stats.doc_id.eqNullSafe(gone.d) & (stats.key == gone.k) & (stats.host == gone.h), "left")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Base statistics and kept for every row of docs (doc_id, text, source; nulls count as empty).

    kept: the base rules hold, and without frequent lines at least min_left words and
    min_left_share per cent of the words are left. Equal rows get equal results.
    """
    gone = depleted(docs, rules).drop("hashes")
    stats = base_stats(docs, rules)
    return _with_lines(stats, gone).drop("host").select(*(c for c in stats.columns if c != "host"), _kept(F.coalesce("gone", F.lit(0)), rules).alias("kept"))


def _kept(gone: Column, rules: Rules) -> Column:
    left = F.col("n_words") - gone
    return ~F.col("base_failed") & ((gone == 0) | (left >= rules.min_left) & (100 * left >= rules.min_left_share * F.col("n_words")))


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of docs that pass, without their host's frequent lines; blank lines stay. The columns of docs.

    n_chars, where there is one, follows the text that is left.
    """
    verdict = written(_verdicts(docs, rules), "verdict")
    good = verdict.where("kept")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._th_key") == F.col("b.key")) & (F.col("a._th_host") == F.col("b.host"))
    left = docs.withColumns({"_th_key": row_key(), "_th_host": _host()}).alias("a").join(good.alias("b"), same)
    kept_lines = F.array_join(F.filter(F.split(F.col("a.text"), "\n"), lambda x: ~F.array_contains(F.col("b.hashes"), F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.size("b.hashes") > 0, kept_lines).otherwise(F.col("a.text"))
    cols = [text.alias("text") if c == "text" else F.col(f"a.`{c}`") for c in docs.columns]
    out = left.select(*cols)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _verdicts(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, key, host, kept and the hashes of frequent lines, one row for each distinct (doc_id, key, host)."""
    both = _with_lines(base_stats(docs, rules), depleted(docs, rules))
    out = both.select("doc_id", "key", "host", _kept(F.coalesce("gone", F.lit(0)), rules).alias("kept"), F.coalesce("hashes", F.array().cast("array<long>")).alias("hashes"))
    return out.dropDuplicates(["doc_id", "key", "host"])
