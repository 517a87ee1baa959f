"""Secret scan by column expressions: fixed patterns, and sliding-window entropy of token-like runs.

Spans are (start, end) in code points, end exclusive. A pattern's matches come with the text between
them (split), so each match starts where the lengths before it sum to; no offsets are searched for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# The patterns asked for and their least lengths.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "entropy"]

#: Candidates for the entropy test: runs of token characters; what stands behind an equals sign is one of its own.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
WINDOW, SHORT_WINDOW = 20, 16
#: Bits a character in the fullest window of 20 and, for shorter candidates, of 16, by the narrowest class that
#: holds the whole candidate: what 99 of 100 random strings of that class and length reach.
LIMITS = [("^[0-9a-fA-F]+$", 2.9, 2.69), ("^[a-z0-9]+$|^[A-Z0-9]+$", 3.4, 3.16), ("^.*$", 3.65, 3.38)]
#: Candidates that are known not to be secrets.
ALLOWED = [
    "^[^0-9]+$", "^[^A-Za-z]+$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "(?i)^(your|my|an?)?[_-]?(example|sample|dummy|placeholder|changeme|test[_-]?key)(?![=/_-])|(example|placeholder|changeme)$",
    "(?i)^(.*[^a-z0-9])?(x{6,}|0{8,}|1234567890+)([^a-z0-9].*)?$",
    "^/?([a-z]+[0-9]*[/_-]){2,}+[a-z]*[0-9]*$", "^[=_+/-]*[A-Za-z]+[0-9]{1,4}$",
    "^(.{1,4})\\1+$",
]

#: Elements that are folded together, and characters of a text that are cut from together.
_CHUNK, _CUT, _BLOCK = 64, 4096, 256


def running(values: Column, zero: Column, fold) -> Column:
    """fold of all elements up to and including each one, by blocks, so that long arrays don't cost their square."""
    block = lambda i: F.shiftright(i, 6)

    def over(a: Column, low: Column, high: Column) -> Column:  # elements low to high - 1
        return F.when(high > low, F.aggregate(F.sequence(low, high - 1), zero, lambda s, j: fold(s, F.get(a, j)))).otherwise(zero)

    def laid(v: Column) -> Column:
        n = F.size(v)
        totals = F.transform(F.sequence(F.lit(0), block(n - 1)), lambda b: over(v, b * _CHUNK, F.least(n, (b + 1) * _CHUNK)))
        heads = lambda t: F.transform(t, lambda _, b: over(t, F.lit(0), b))
        within = lambda h: F.transform(v, lambda _, i: fold(F.get(h, block(i)), over(v, block(i) * _CHUNK, i + 1)))
        return bind(totals, lambda t: bind(heads(t), within))

    return F.when(F.size(values) == 0, F.slice(values, 1, 0)).otherwise(bind(values, laid))


def spans(text: Column, pattern: str, kind: str, test: Column | None, value: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches whose group value has least characters: array of (start, end, kind, text)."""
    number = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,text:string>>")
    def found(m: Column) -> Column:
        pieces = F.split(text, pattern)
        both = F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda a, gap: F.struct(F.length(gap).alias("gap"), F.length(a["whole"]).alias("len"), a["whole"].alias("text"), F.length(a["value"]).alias("vlen")))

        def placed(b: Column) -> Column:
            ends = running(F.transform(b, lambda x: x["gap"] + x["len"]), F.lit(0), lambda s, x: s + x)
            rows = F.zip_with(b, ends, lambda x, e: F.struct((e - x["len"]).alias("start"), e.alias("end"), F.lit(number).alias("kind"), F.when(x["vlen"] >= least, x["text"]).alias("text")))
            return F.filter(rows, lambda x: x["text"].isNotNull())

        return bind(both, placed)

    whole, part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(value + 1))
    matches = F.zip_with(whole, part, lambda a, b: F.struct(a.alias("whole"), b.alias("value")))
    if not value:
        matches = F.transform(whole, lambda a: F.struct(a.alias("whole"), a.alias("value")))
    out = bind(matches, found)
    return F.when(test, out).otherwise(empty) if test is not None else out


def _least_sum(block: Column, window: int) -> Column:
    """Least sum of f(count) over the windows of a block of printable ASCII characters, f(n) = n log2 n.

    Counts are kept up step by step: each step changes those of the character that leaves and of the one
    that enters. They stand in longs, five bits for each of the 96 characters.
    """
    table = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    f = lambda n: F.get(table, n)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c["at"])
    held = lambda counts, c: F.call_function("shiftright", F.get(counts, c["word"]), c["at"]).bitwiseAND(31).cast("int")
    code = lambda c: F.ascii(c) - 32
    cells = F.transform(F.split(block, ""), lambda c: F.struct((code(c) / 12).cast("int").alias("word"), (code(c) % 12 * 5).alias("at")))

    def folded(c: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(c, i), F.get(c, i - window)  # null in the first window
            leaves = F.coalesce(held(acc["counts"], old), F.lit(0))
            same = F.coalesce((old["word"] == new["word"]) & (old["at"] == new["at"]), F.lit(False))
            before = held(acc["counts"], new) - same.cast("int")
            total = acc["s"] + F.when(leaves > 0, f(leaves - 1) - f(leaves)).otherwise(0.0) + f(before + 1) - f(before)
            counts = F.transform(acc["counts"], lambda v, j: v + F.when(j == new["word"], one(new)).otherwise(0) - F.when(j == old["word"], one(old)).otherwise(0))
            return F.struct(total.alias("s"), F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"), counts.alias("counts"))

        begin = F.struct(F.lit(0.0).alias("s"), F.lit(window * math.log2(window)).alias("least"), F.array_repeat(F.lit(0).cast("long"), 8).alias("counts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), begin, step, lambda a: a["least"])

    return bind(cells, folded)


def _blocks(s: Column, window: int) -> Column:
    """s in blocks that overlap by a window less one, so each window is in one and none is cut from far into s."""
    return bind(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.right(F.get(p, i - 1), F.lit(window - 1)), x))))


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of a window of string s; 0 where s is shorter than a window."""
    lows = F.transform(_blocks(s, window), lambda b: _least_sum(b, window))
    return F.coalesce(math.log2(window) - F.array_min(lows) / window, F.lit(0.0))


def reaches(s: Column, limit: Column, window: int = WINDOW) -> Column:
    """Whether a window of s has an entropy of limit or more; looks no further than the first block that has one."""
    return bind(window * (math.log2(window) - limit) + 1e-9, lambda most: F.exists(_blocks(s, window), lambda b: _least_sum(b, window) <= most))


def _entropy_spans(text: Column) -> Column:
    def secret(x: Column) -> Column:
        s = x["text"]
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | s.rlike(p)
        limit = lambda k: F.coalesce(*(F.when(s.rlike(row[0]), F.lit(row[k])) for row in LIMITS))
        return F.when(allowed, F.lit(False)).when(F.length(s) >= WINDOW, reaches(s, limit(1))).otherwise(reaches(s, limit(2), SHORT_WINDOW))

    return F.filter(spans(text, CANDIDATE, "entropy", text.rlike(CANDIDATE)), secret)


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with a column spans: array of (start, end, kind) by start, then kind as in KINDS.

    docs: doc_id, text and any further columns (kept). Null and empty texts have no spans. base
    holds the fixed patterns' spans only. Entropy spans that lie within a base span say nothing
    new and are left out. Repeated rows give repeated rows, an empty table an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    assign = spans(text, ASSIGN, "assign", text.rlike(ASSIGN), 2, LEAST["assign"])
    access = spans(text, f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", "access", F.contains(text, F.lit("AKIA")))  # a run's first AKIA is its longest match
    hexes = spans(text, f"[0-9a-f]{{{LEAST['hex']},}}", "hex", text.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"))  # whole runs, as the bare class finds them
    base = F.concat(assign, access, hexes)
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    def joined(b: Column) -> Column:
        # Those that start before, or in the same place with a fixed pattern's span first, say how far spans reach.
        mixed = F.array_sort(F.transform(F.concat(b, plain(_entropy_spans(text))), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
        far = lambda a: running(F.transform(a, lambda x: F.when(x["kind"] < KINDS.index("entropy"), x["end"]).otherwise(0)), F.lit(0), F.greatest)
        kept = lambda a: bind(far(a), lambda r: F.filter(a, lambda x, i: (x["kind"] < KINDS.index("entropy")) | (F.get(r, i) < x["end"])))
        return F.struct(b.alias("base"), F.when(F.size(mixed) == F.size(b), b).otherwise(bind(mixed, kept)).alias("spans"))

    return docs.withColumn("_th_found", bind(F.array_sort(plain(base)), joined)).withColumns({"base": F.col("_th_found.base"), "spans": F.col("_th_found.spans")}).drop("_th_found")


def as_text(a: Column) -> Column:
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs (doc_id, text)."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def _between(pieces: Column, low: Column, high: Column) -> Column:
    """Characters low to high - 1 of a text that is cut into pieces of _CUT characters."""
    a, b = F.shiftright(low, 12), F.shiftright(high, 12)
    one = F.substring(F.get(pieces, a), low % _CUT + 1, high - low)
    more = F.concat(F.substring(F.get(pieces, a), low % _CUT + 1, F.lit(_CUT)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(pieces, b), F.lit(1), high % _CUT), F.lit("")))
    return F.when(high <= low, "").when(a == b, one).otherwise(more)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mask, overlapping spans as one; the columns of docs.

    Texts without secrets stay as they are, nulls too; n_chars, where there is one, follows the text.
    """
    inner = docs.select("*", F.col("text").alias("_th_text"))
    marked = find_secrets(inner.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_th_row"), F.col("_th_text").alias("text")))
    text = F.col("text")

    def cut(a: Column) -> Column:
        """Between the spans' ends so far and the next span's start the text stays; where there is no such place, two spans are one."""

        def parts(r: Column, pieces: Column) -> Column:
            gaps = F.transform(a, lambda x, i: F.when(i == 0, _between(pieces, F.lit(0), x["start"])).when(x["start"] >= F.get(r, i - 1), _between(pieces, F.get(r, i - 1), x["start"])))
            kept = F.transform(gaps, lambda g: F.when(g.isNotNull(), F.concat(g, F.lit(mask))).otherwise(""))
            return F.concat(F.array_join(kept, ""), _between(pieces, F.get(r, F.size(r) - 1), F.length(text)))

        reach = running(F.transform(a, lambda x: x["end"]), F.lit(0), F.greatest)
        return bind(reach, lambda r: bind(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)), lambda p: parts(r, p)))

    fixed = F.when(F.size("spans") > 0, bind(F.col("spans"), cut)).otherwise(text)
    out = marked.select("_th_row", fixed.alias("_th_text"), (F.size("spans") > 0).alias("_th_cut"))
    changed = {"text": F.col("_th_text"), "n_chars": F.when(F.col("_th_cut"), F.length("_th_text")).otherwise(F.col("_th_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("_th_text")}
    return out.select(*((changed[c].cast(docs.schema[c].dataType) if c in changed else F.col(f"_th_row.`{c}`")).alias(c) for c in docs.columns))
