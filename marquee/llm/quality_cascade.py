"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Boolean expression that says whether it rejects a document. On a sample, ``measured`` finds each rule's cost
(seconds a row, of an aggregate that evaluates it, net of the same aggregate without it; the rows are repeated until the rule takes as long as the rest of the job) and
selectivity (share rejected); rules too cheap to be told from the job's own variation cost that much. ``ordered`` sorts the rules by
rejections per second, the order that minimises the expected cost of a conjunction of independent rules;
``cascade`` turns them into one ``CASE WHEN``, whose later branches Spark evaluates only for documents that the earlier ones let
pass. The verdict is the same in any order.

Edge cases: a null text has no words; texts of any length are judged whole, each in its row; an empty table gives an empty result; repeated rows are judged one by one; only the
id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import stored

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3
SAMPLE_ROWS = 2000
#: How often the sample's rows are read until a rule shows.
COPIES = (1, 8, 64)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the counts that rules are made of, one row per input row.

    Words are runs of characters other than blanks. ``n_repeat_words`` counts the words inside three-word windows that occur twice
    or more in the text: the windows' strings are put in a hash set first, and only texts where some window is missing from it sort
    theirs with positions, so that equal ones become neighbours.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"),
        F.array_remove(F.split(text, BLANK), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.concat_ws(" ", *[F.element_at("words", (i + j).cast("int")) for j in range(WINDOW)])
    )).otherwise(F.array().cast("array<string>"))
    wide = split.select("doc_id", "text", "words", "lines", windows.alias("windows"))
    found = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    sizes = wide.select(
        "doc_id", "text", "windows",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), found).alias("found"),
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.zip_with(
        "found", F.slice("found", 2, F.size("found")),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    ))))
    placed = sizes.select(*[c for c in sizes.columns if c not in ("windows", "found")], F.when(F.col("found").isNotNull(), places).alias("places"))
    covered = F.aggregate(
        F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda total, x: total + x,
    )
    return placed.select(
        *[c for c in placed.columns if c != "places"],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def standard_rules() -> list[Rule]:
    """Rules over ``counts`` and the text, with thresholds in use for web text: word length, symbols, repeated lines, shouting."""
    c = F.col
    return [
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule("shouting", 2 * F.regexp_count("text", F.lit("[A-Z]")) > c("word_chars")),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows, chosen at random from the whole table, in the shared folder."""
    total = docs.count()
    part = docs if total <= rows else docs.sample(fraction=rows / total, seed=seed)
    return stored(part, "cascade-sample")


def measured(sample: DataFrame, rules: list[Rule], repeats: int = 2, copies: tuple[int, ...] = COPIES) -> list[dict]:
    """Cost and selectivity of each rule over a sample that already has the columns which the rules read."""
    rows = sample.count()

    def timed(rule: Column, times: int) -> list[float]:
        """Seconds of a job that reads every column of every row so many times and evaluates the rule."""
        again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        touched = [F.count_if(F.col(c).isNull()) for c in sample.columns]
        seconds = []
        for _ in range(repeats):
            start = time.perf_counter()
            again.agg(F.count_if(rule), *touched).collect()
            seconds.append(time.perf_counter() - start)
        return sorted(seconds)

    # The rule that no row meets still depends on the row, so that it is not worked out beforehand.
    idle = {times: timed(F.col("_again") < 0, times) for times in copies}
    found = []
    for rule in rules:
        rejects = F.coalesce(rule.rejects, F.lit(False))
        rejected = sample.agg(F.count_if(rejects)).first()[0]
        for times in copies:
            net = timed(rejects, times)[0] - idle[times][0]
            if net >= idle[times][0]:
                break
        variation = max(idle[times][-1] - idle[times][0], idle[times][0] / 20)
        found.append({"rule": rule, "cost": max(net, variation) / max(1, rows * times), "rejects": rejected / rows if rows else 0.0})
    return found


def ordered(figures: list[dict]) -> list[Rule]:
    """Most rejections per second first; equal ones by name."""
    return [x["rule"] for x in sorted(figures, key=lambda x: (-x["rejects"] / max(x["cost"], 1e-15), x["rule"].name))]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a document, null if all let it pass; later rules are not evaluated."""
    first = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        first = first.when(rule.rejects, F.lit(rule.name))
    return first


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The counts, ``base_failed``, ``kept`` and ``rejected_by`` of every document.

    ``base_failed``: under 50 words, or more than half of them in repeated windows. Which of several failing rules ``rejected_by``
    names depends on the measured order; ``kept`` does not.
    """
    rules = standard_rules() if rules is None else rules
    sample = stored(counts(sampled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))), "cascade-counts")
    order = ordered(measured(sample, rules))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts(docs, id_col, text_col).withColumn("base_failed", base)
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("text")


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, without ``rejected_by``, which timing may change."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


SQL = r"""
with split as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
  from (select r, words, unnest(range(1, len(words) - 1)) as i from split)
), repeated as (
  select r, i from (select r, i, count(*) over (partition by r, w) as n from windows) where n > 1
), covered as (
  select r, count(distinct i + j) as n from repeated, (select unnest([0, 1, 2]) as j) group by r
), counted as (
  select s.*, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper
  from split s left join covered c using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
    or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or 2 * n_upper > word_chars) as kept
from counted
"""
