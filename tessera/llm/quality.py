"""Quality rules: a threshold table compiled into one Spark projection. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = ("the of and to in is that it for was on with as be at by this have from or an are "
              "le la les de des du et en un une est que qui dans pour par sur au pas "
              "el los las y del se con por una su para al lo como más "
              "der die das und den von zu mit sich dem nicht ein eine als auf für ist im").split()  # fmt: skip


@dataclass(frozen=True)
class Rule:
    """Passes if low * per <= 100 * value <= high * per; value and per are measures."""

    name: str
    value: str
    per: str
    low: int | None = None
    high: int | None = None


#: The threshold table, in hundredths.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols to words", "n_symbols", "n_words", None, 10),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("distinct stop words", "n_stop_words", "one", 200, None),
)
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30


def measures(text: Column) -> tuple[dict[str, Column], ...]:
    """Layers of named measures; each layer may use the columns of those before."""
    t = F.coalesce(text, F.lit(""))
    first = {"t": t, "w": F.split(F.trim(t, F.lit(" \t\n\x0b\f\r")), f"{SPACE}+")}
    w, t = F.col("w"), F.col("t")
    second = {
        "w": F.filter(w, lambda x: x != ""),
        "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    }
    bits = "length(bin(n))"
    third = {"n": F.size("w")}
    # the hash of each window and its place in one number, sorted: equal windows are neighbours
    fourth = {"s": F.expr(f"sort_array(CASE WHEN n >= {WINDOW} THEN transform(sequence(0, n - {WINDOW}), i -> shiftleft(xxhash64(slice(w, i + 1, {WINDOW})), {bits}) | CAST(i AS BIGINT)) ELSE CAST(array() AS array<bigint>) END)"), "b": F.expr(bits), "mask": F.expr(f"shiftleft(1L, {bits}) - 1")}
    same = lambda other: f"(shiftright(x, b) = shiftright({other}, b) AND slice(w, CAST(x & mask AS INT) + 1, {WINDOW}) = slice(w, CAST({other} & mask AS INT) + 1, {WINDOW}))"
    fifth = {"p": F.expr(f"sort_array(transform(filter(s, (x, i) -> coalesce({same('get(s, i - 1)')}, false) OR coalesce({same('get(s, i + 1)')}, false)), x -> x & mask))")}
    sixth = {
        "n_words": F.col("n").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_stop_words": F.size(F.array_intersect(F.col("w"), F.array(*[F.lit(x) for x in STOP_WORDS]))).cast("long"),
        "n_repeat_words": F.expr(f"aggregate(transform(p, (x, i) -> least({WINDOW}L, coalesce(get(p, i + 1) - x, {WINDOW}L))), 0L, (a, x) -> a + x)"),
        "one": F.lit(1).cast("long"),
    }
    return first, second, third, fourth, fifth, sixth


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    out = F.lit(True)
    for r in rules:
        value, per = F.col(r.value) * 100, F.col(r.per)
        if r.low is not None:
            out = out & (value >= per * r.low)
        if r.high is not None:
            out = out & (value <= per * r.high)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of docs.

    Null and empty texts have no words and aren't kept. Equal rows are judged alike. Other columns of docs are ignored.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    have: dict[str, Column] = {}
    for layer in measures(F.col("text")):
        have |= {c: F.col(c) for c in have} | layer
        df = df.select("doc_id", *[v.alias(k) for k, v in have.items()])
        have = {c: F.col(c) for c in have}
        drop = {"p": ("s", "mask", "b"), "w": ()}.get(next(iter(layer)), ())
        have = {c: v for c, v in have.items() if c not in drop}
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"))
