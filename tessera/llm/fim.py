"""Fill-in-middle transformation in relational units.

A text is a sequence of *units*: the successive matches of a pattern that covers it (code points, or words with
the space before them). Two cuts, given as numbers of units, divide it into prefix, middle and suffix, which are
written in one of two orders with marks between them:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is, where it is empty, holds a mark, or is not drawn.

Plan. Matches are exploded with their places, window sums of their lengths turn unit ordinals into offsets, cut
requests join by ordinal, and the two offsets of a document are aggregated and cut out with ``substring``. So
that a text of a million units is not a million shuffled rows, this runs at two levels: runs of ``RUN`` units
first (a row a run: its place and length), and single units only inside the runs that a request falls into.
Every unit is matched and counted. Texts are shuffled once, by row: what counts their units and what cuts them
reads the same exchange; besides it only requests and the runs asked for are shuffled. All keys are row numbers
of a written table, so no key repeats and repeated rows stay apart.

Drawing is by the sha256 of ``seed`` and the decimal doc_id, so it does not depend on partitions or other rows.

Defined cases: a null text is empty; an empty text is plain with no units; a null doc_id is drawn like an empty
one; repeated rows give repeated equal results; a very long text makes as many rows as it has runs; equal cuts
give an empty middle; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Units: code points, and words with the white space before them (what is left at the end is one more).
POINT, WORD = r"(?s:.)", r"\s*\S+|\s+"
#: Fixed values of the contract: the marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a run.
RUN = 32


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def unit_count(text: Column, unit: str) -> Column:
    return (F.char_length(text) if unit == POINT else F.regexp_count(text, F.lit(unit))).cast("long")


def offsets(texts: DataFrame, requests: DataFrame, *, unit: str = POINT, run: int = RUN) -> DataFrame:
    """(row, side, at): how many code points lie up to the end of unit ``ordinal`` of a text.

    ``texts`` has row, text and wanted (the ordinals asked for); ``requests`` has row, side and ordinal, from 1.
    """
    place = lambda ordinal: F.floor((ordinal - 1) / F.lit(run)).cast("int")
    # Outer, as it says nothing about the texts that could be tested before they are joined.
    runs = texts.select("row", "wanted", F.posexplode_outer(F.when(F.col("wanted").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?:(?>{unit})){{1,{run}}}+"), F.lit(0)))).alias("number", "span"))
    asked = F.exists("wanted", lambda o: (o > 0) & (place(o) == F.col("number")))
    lengths = runs.filter("number is not null").select("row", "number", F.char_length("span").cast("long").alias("chars"), F.when(asked, F.col("span")).alias("span"))
    earlier = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    summed = lengths.withColumn("before", F.coalesce(F.sum("chars").over(earlier), F.lit(0)))
    # In as many partitions as a shuffle has: each run becomes ``run`` rows, which its own size does not tell.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hit = summed.filter(F.col("span").isNotNull()).select("row", "number", "before", "span").repartition(parts, "row", "number")
    # A request meets its run by row and place; inside the run the units are counted one by one.
    met = requests.filter("ordinal > 0").withColumn("number", place(F.col("ordinal"))).join(hit, ["row", "number"])
    units = met.select("row", "number", "side", "before", (F.pmod(F.col("ordinal") - 1, F.lit(run))).cast("int").alias("wanted"), F.posexplode(F.regexp_extract_all("span", F.lit(unit), F.lit(0))).alias("k", "match"))
    so_far = Window.partitionBy("row", "number", "side").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    counted = units.select("row", "number", "side", "before", "wanted", "k", F.char_length("match").alias("chars"))
    ends = counted.withColumn("at", F.col("before") + F.sum("chars").over(so_far))
    return ends.filter("k = wanted").select("row", "side", "at")


def transform(docs: DataFrame, *, unit: str = POINT, drawn: int = 90, spm: int = 20, seed: str = "1:", run: int = RUN, written: bool = False) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output of each document.

    ``drawn`` of a hundred documents are transformed, ``spm`` of a hundred of these in that order. ``written`` says
    that ``docs`` is a table as it was written, which gives the same rows in the same partitions each time it is
    read; anything else is written to the shared folder first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = (rows if written else cut(rows, "fim-rows")).withColumn("row", F.monotonically_increasing_id())
    h = draws(F.col("doc_id"), seed)
    a, b = (F.pmod(x, F.col("n") + 1) for x in h[:2])
    marked = F.instr("text", PREFIX) + F.instr("text", SUFFIX) + F.instr("text", MIDDLE) > 0
    plain = (F.col("text") == "") | marked | (F.pmod(h[2], F.lit(100)) >= drawn)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm")
    asked = rows.withColumn("n", unit_count(F.col("text"), unit)).select("row", "doc_id", "n", form.alias("form"), F.least(a, b).alias("small"), F.greatest(a, b).alias("large"))
    asked = cut(asked, "fim-asked")
    requests = asked.filter("form <> 'plain'").select("row", F.posexplode(F.array("small", "large")).alias("side", "ordinal"))
    # The texts meet their requests by row, and stay dealt by it: runs, their sums and the last join need no other exchange of texts.
    texts = rows.select("row", "text")
    wanted = asked.select("row", F.when(F.col("form") != "plain", F.array("small", "large")).alias("wanted"))
    found = offsets(texts.join(wanted.hint("shuffle_hash"), "row"), requests, unit=unit, run=run)
    of_row = found.groupBy("row").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("p"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("q"))
    joined = texts.join(asked.join(of_row, "row", "left").hint("shuffle_hash"), "row")
    p, q = (F.when(F.col("form") != "plain", F.coalesce(c, F.lit(0))) for c in ("p", "q"))
    return joined.select("doc_id", "text", "n", "form", p.alias("prefix_chars"), (q - p).alias("middle_chars")).withColumn("output", arranged())


def arranged() -> Column:
    """The text in its form, from prefix_chars and middle_chars."""
    p, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m)
    suffix = F.substring("text", p + m + 1, F.char_length("text"))
    return (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts, cut at the marks, put back in order."""
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output))
    head, rest = F.split_part(body, first, F.lit(1)), F.split_part(body, first, F.lit(2))
    tail, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(tail, middle, head)).otherwise(output)


#: The same rows of the query, by plain string functions.
ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents
), d AS (
  SELECT *, CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2,
    CAST(concat('0x', h[17:24]) AS BIGINT) AS h3, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', substring(text, 1, p), '<S>', substring(text, q + 1), '<M>', substring(text, p + 1, q - p))
    ELSE concat('<S>', substring(text, q + 1), '<P>', substring(text, 1, p), '<M>', substring(text, p + 1, q - p)) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""
