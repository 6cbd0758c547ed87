"""Line dedup by winnowing over line hashes, in DataFrame expressions only.

Lines are compared without surrounding blanks (space, tab, vertical tab, form feed, carriage return); blank lines are passed over, so a run continues across them. A run is ``min_run`` lines or more, or
one long line of ``long_words`` words or more.

1. Of every window of ``min_run`` lines the smallest line hash (the rightmost of equal ones) is its fingerprint, and a long line is its own. Only these minima are stored, with their places.
   Equal windows choose equal fingerprints at the same place, so whatever run two places share, they share a fingerprint in it.
2. The places of equal fingerprints are joined; fingerprints that stand at one place only are done, and so are the texts that have no other.
3. In the other texts the fingerprints that met are extended to the left and to the right, to the windows that they stand for, and these are compared by a digest of their lines.
   Equal windows that overlap or touch make up the maximal runs.
4. The earliest occurrence by (doc_id, text hash, line) stays. A line of a later occurrence goes if the first one is in another document; within one document it goes unless it belongs
   to a first occurrence itself, so of a line repeated without end the first run stays.

No step gathers the places of a frequent line: groups are reduced by min and max before the shuffle, and the joins have
a side with unique keys, whose other side Spark may split.

Edge cases: null text stays null; rows that repeat both id and text are one document and all stay; a run repeated within
one document keeps its first place; documents under ``min_run`` lines change by long lines only; texts and lines of any length are handled whole, a document a row; an empty table stays empty.
Columns named ``winnow_*`` are the operator's own and replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import stored

MIN_RUN = 2
#: Words from which a single line is a run.
LONG_WORDS = 8
BLANK = " \t\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def solid_lines(text: Column) -> Column:
    """The lines that are not blank: number, text without surrounding blanks, hash and whether it is long."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), F.trim(line, F.lit(BLANK)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def hashed(lines: Column) -> Column:
    """Per line: its hash, and minus its place, so that of equal hashes the rightmost is the least."""
    return F.transform(lines, lambda x, k: F.struct(F.xxhash64(x["line"]).alias("print"), (-k).alias("back")))


def window(items: Column, start: Column, min_run: int) -> Column:
    """``min_run`` items from a place on; unlike ``slice``, it does not copy the whole array for each."""
    return F.array(*[F.get(items, start + j) for j in range(min_run)])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, min_run: int, long_words: int) -> DataFrame:
    """One row per document and minimum: doc, version (hash of the text), whether it is a long line of its own, hash and place."""
    text = F.col(text_col)
    full = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), solid_lines(text).alias("lines"))
    full = full.withColumn("hashes", hashed(F.col("lines")))
    starts = F.when(F.size("lines") >= min_run, F.sequence(F.lit(0), F.size("lines") - min_run)).otherwise(F.array().cast("array<int>"))
    least = F.array_distinct(F.transform(starts, lambda s: -F.array_min(window(F.col("hashes"), s, min_run))["back"]))  # numbers, which it hashes
    alone = F.filter("hashes", lambda h: F.regexp_count(F.get(F.col("lines"), -h["back"])["line"], F.lit(WORD)) >= long_words)
    marks = F.concat(F.transform(least, lambda k: F.struct(F.lit(False).alias("alone"), F.get("hashes", k)["print"].alias("print"), k.alias("place"))),
                     F.transform(alone, lambda h: F.struct(F.lit(True).alias("alone"), h["print"].alias("print"), (-h["back"]).alias("place"))))
    return full.select("doc", "version", F.inline(marks))


def extended(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, min_run: int) -> DataFrame:
    """The windows around the fingerprints that met: doc, version, the numbers of the lines and the digest of their text."""
    text = F.col(text_col)
    met = marks.groupBy(F.col("doc").alias("_doc"), F.col("version").alias("_version")).agg(
        F.array_sort(F.collect_set(F.when(~F.col("alone"), F.col("place")))).alias("places"), F.array_sort(F.collect_set(F.when(F.col("alone"), F.col("place")))).alias("long"))
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), text.alias("_text"))
    rows = rows.join(met, rows["doc"].eqNullSafe(met["_doc"]) & (rows["version"] == met["_version"])).withColumn("lines", solid_lines(F.col("_text"))).withColumn("hashes", hashed(F.col("lines")))

    def around(k: Column) -> Column:
        """The windows of which this place is the least hash, so that each window comes once."""
        near = F.sequence(F.greatest(k - (min_run - 1), F.lit(0)), F.least(k, F.size("lines") - min_run))
        own = F.filter(near, lambda s: F.array_min(window(F.col("hashes"), s, min_run))["back"] == -k)
        return F.transform(own, lambda s: window(F.col("lines"), s, min_run))

    spans = F.concat(F.flatten(F.transform("places", around)), F.transform("long", lambda k: window(F.col("lines"), k, 1)))
    return rows.select("doc", "version", F.explode(spans).alias("span")).select(
        "doc", "version", F.transform("span", lambda x: x["i"]).alias("at"), F.unhex(F.md5(F.array_join(F.transform("span", lambda x: x["line"]), "\n"))).alias("digest"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """doc, version (hash of the text) and the sorted numbers of the lines to delete."""
    found = stored(fingerprints(docs, id_col, text_col, min_run, long_words), "winnow")
    place = F.struct("doc", "version", "place")
    # Written before they are joined, so that the join's other side has a shuffle of its own, which Spark may split.
    prints = stored(found.groupBy("alone", "print").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("alone", "print"), "winnow-prints")
    near = stored(extended(docs, found.join(prints, ["alone", "print"], "left_semi"), id_col, text_col, min_run), "winnow-windows")
    span = F.struct("doc", "version", "at")
    firsts = stored(near.groupBy("digest").agg(F.min(span).alias("first"), F.max(span).alias("last")).where("first <> last").select("digest", "first"), "winnow-firsts")
    other = ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("version") == F.col("first.version")))
    placed = near.join(firsts, "digest").select("doc", "version", F.explode("at").alias("line"), (span == F.col("first")).alias("stays"), other.alias("other"))
    gone = placed.groupBy("doc", "version", "line").agg(F.bool_or("stays").alias("stays"), F.bool_or("other").alias("other")).where("other or not stays")
    return gone.groupBy("doc", "version").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with repeated runs deleted from the text, and ``winnow_lines``, ``winnow_deleted``: its lines before, and how many went."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("winnow_")])
    gone = repeated_lines(docs, id_col, text_col, min_run, long_words).select(
        F.col("doc").alias("winnow_doc"), F.col("version").alias("winnow_version"), F.col("gone").alias("winnow_gone"),
    )
    on = F.col(id_col).eqNullSafe(F.col("winnow_doc")) & (F.xxhash64(text_col) == F.col("winnow_version"))
    joined = docs.join(gone, on, "left").withColumn("winnow_all", F.split(text_col, "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("winnow_all") - 1), "winnow_gone")
    text = F.when(F.col("winnow_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get("winnow_all", i)), "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size("winnow_all"), F.lit(0)).cast("long").alias("winnow_lines"),
        F.coalesce(F.size("winnow_gone"), F.lit(0)).cast("long").alias("winnow_deleted"),
    )


def op8_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the deleted ones, and a digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("winnow_lines").alias("n_lines"), F.col("winnow_deleted").alias("n_deleted"), F.md5("text").alias("text_md5"),
    )


SQL = r"""
with lines as (
  select doc_id, unnest(range(len(parts))) as i, unnest(parts) as line
  from (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null)
), trimmed as (
  select doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as body from lines
), solid as (
  select doc_id, i, row_number() over (partition by doc_id order by i) as k, body from trimmed where body <> ''
), windows as (
  select doc_id, [i, lead(i) over (partition by doc_id order by k)] as covers, body || chr(10) || lead(body) over (partition by doc_id order by k) as content from solid
  union all
  select doc_id, [i] as covers, body as content from solid where len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= 8
), ranked as (
  select *, row_number() over w as nth, first_value(doc_id) over w as source, count(*) over (partition by content) as n
  from windows where content is not null window w as (partition by content order by doc_id, covers)
), covered as (
  select doc_id, unnest(covers) as i, nth = 1 as stays, source <> doc_id as other from ranked where n > 1
), gone as (
  select doc_id, i from covered group by all having bool_or(other) or not bool_or(stays)
), rest as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) filter (where g.i is null) as text, count(g.i) as n_deleted, count(*) as n_lines
  from lines l left join gone g using (doc_id, i) group by 1
)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_deleted, 0)::bigint as n_deleted,
  case when d.text is not null then md5(coalesce(r.text, '')) end as text_md5
from documents d left join rest r using (doc_id)
"""
