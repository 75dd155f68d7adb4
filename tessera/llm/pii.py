"""Information-theoretic sanitisation of personal data.

Pattern spans (e-mail, IP, card, phone) are the *protected entities*. Words near them are candidate
*terms*. Over the whole corpus we count how often a term stands near an entity and how often either
occurs. A term ``t`` discloses an entity ``e`` where

    PMI(t; e) >= disclosure * IC(e),   PMI = log2(N * co(t, e) / (df(t) * df(e))),   IC = log2(N / df(e))

and at least ``min_support`` different passages show the two together (copies of one passage count
once as evidence). Such a term is generalised to its prefix class ``abc*`` where the class as a whole
stays under the threshold, and removed otherwise, wherever it stands in a document that names the entity.

Plan: one scan counts terms (pre-aggregated in the task), one scan finds spans and contexts and is
written to the shared folder, with the texts that name an entity. The terms of a document's entities are
joined by entity and brought to its text by row number; a text that names none is in no shuffle.

Defined cases: null text is empty; empty tables give empty results; a repeated row gives a repeated
result row; very long texts, runs of digits and thousands of spans take time in proportion to their length;
equally strong terms are treated alike, and a term that one entity generalises and another removes is removed;
further columns are ignored by :func:`find_spans` and kept by :func:`sanitise`; a null doc_id stays null. Spans
are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, text_strings

#: Fixed values of the contract: kinds in the order in which spans are listed; ``term`` spans follow.
KINDS = ("email", "ip", "card", "phone")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[REMOVED]"}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins: a later start in the same run meets the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if place % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: linear however long a run is."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's spans of each kind, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def entity_key(kind: str, value: str) -> str:
    """One key for all spellings of an entity."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def joined_spans(spans: dict[str, list[tuple[int, int]]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans of all kinds cover together, in order and without overlaps."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(x for k in KINDS for x in spans[k]):
        if ends and s <= ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def contexts(text: str, spans: dict[str, list[tuple[int, int]]], window: int) -> list[tuple[str, str, int, int, int]]:
    """(entity, term, hash of the passage, start, end) of the words within ``window`` words of a span."""
    marked = sorted((s, e, k) for k in KINDS for s, e in spans[k])
    if not marked:
        return []
    runs, rows = [m.span() for m in _TERM.finditer(text)], []
    first, last = [s for s, _ in runs], [e for _, e in runs]
    starts, ends = joined_spans(spans)
    for start, end, kind in marked:
        entity = entity_key(kind, text[start:end])
        # The words before and after, however far; of a word that touches the span, the part outside it.
        at = bisect_left(first, start)
        left = [(s, min(e, start)) for s, e in runs[max(0, at - window - 1) : at]]
        at = bisect_right(last, end)
        right = [(max(s, end), e) for s, e in runs[at : at + window + 1]]
        left, right = ([x for x in side if x[1] - x[0] >= 3] for side in (left, right))
        clear = []
        for s, e in left[-window:] + right[:window]:
            k = bisect_left(starts, e) - 1  # the last that begins before the word ends
            if k < 0 or ends[k] <= s:
                clear.append((s, e))
        words = [text[s:e].lower() for s, e in clear]
        passage = int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)
        rows += [(entity, w, passage, s, e) for w, (s, e) in zip(words, clear)]
    return rows


def occurrences(text: str, spans: dict[str, list[tuple[int, int]]], shown: dict[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, what is shown instead) of the terms of ``shown`` wherever they stand outside the spans."""
    out = []
    starts, ends = joined_spans(spans)
    for m in _TERM.finditer(text):
        s, e = m.span()
        k = bisect_right(ends, s)
        while s < e:  # the parts of a word that spans leave
            until = min(e, starts[k]) if k < len(starts) else e
            if until - s >= 3 and (put := shown.get(text[s:until].lower())) is not None:
                out.append((s, until, put))
            s = ends[k] if k < len(starts) else e
            k += 1
    return out


_SCAN_SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base string, n_chars long, entities array<string>, "
    "context array<struct<entity:string,term:string,passage:long>>, named string"
)
_SCAN_ARROW = pa.struct([("entity", pa.string()), ("term", pa.string()), ("passage", pa.int64())])


def scan_spans(docs: DataFrame, kept: list[str], window: int = 8) -> DataFrame:
    """doc (a struct of the columns ``kept``), row, base spans, entities and their contexts of each document.

    ``named`` is the text where it names an entity, and null elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base, lengths, entities, context, named = [], [], [], [], []
            for text in text_strings(batch.column(1)):
                spans = base_spans(text)
                for n, kind in zip(counts, KINDS):
                    n.append(len(spans[kind]))
                base.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k]))
                lengths.append(len(text))
                entities.append(sorted({entity_key(k, text[s:e]) for k in KINDS for s, e in spans[k]}))
                context.append([dict(zip(("entity", "term", "passage"), c)) for c in dict.fromkeys(x[:3] for x in contexts(text, spans, window))])
                named.append(text if entities[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(lengths, pa.int64()),
                    pa.array(entities, pa.list_(pa.string())), pa.array(context, pa.list_(_SCAN_ARROW)), pa.array(named, pa.string()),
                ],
                ["doc", *(f"n_{k}" for k in KINDS), "base", "n_chars", "entities", "context", "named"],
            )

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), "text")
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {_SCAN_SCHEMA}").withColumn("row", F.monotonically_increasing_id())


def term_counts(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(term, df): in how many documents each term occurs. Tasks add up to ``flush`` terms before they ship them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])

        for batch in batches:
            for text in text_strings(batch.column(0)):
                seen.update(set(_TERM.findall(text.lower())))
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing_terms(scanned: DataFrame, counts: DataFrame, *, disclosure: float = 0.9, min_support: int = 3) -> DataFrame:
    """(entity, term, action, shown): the terms that reveal an entity, with ``generalise`` or ``remove``.

    Every count is over all documents and is pre-aggregated before its shuffle, so an entity that a
    third of the corpus names costs one row a task.
    """
    n_docs = F.lit(float(scanned.count()))
    entity_df = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    in_doc = scanned.select(F.explode("context").alias("c")).select("c.*")
    pairs = (
        in_doc.groupBy("entity", "term", "passage").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("co"), F.count(F.lit(1)).alias("support"))
        .filter(F.col("support") >= min_support)
    )
    prefix = F.substring("term", 1, 3)
    class_df = counts.groupBy(prefix.alias("prefix")).agg(F.sum("df").alias("df_class"))
    bound = F.lit(disclosure) * F.log2(n_docs / F.col("df_e"))
    reveals = lambda co, df: F.log2(n_docs * co / (df * F.col("df_e"))) >= bound
    flagged = (
        pairs.join(counts, "term").join(entity_df, "entity")
        .filter((n_docs > F.col("df_e")) & reveals(F.least("co", "df"), F.col("df")))
    )
    return (
        flagged.withColumn("prefix", prefix).join(class_df, "prefix", "left")
        .withColumn("general", ~F.coalesce(reveals(F.least("co", "df_class"), F.col("df_class")), F.lit(True)))
        .select(
            "entity", "term",
            F.when(F.col("general"), "generalise").otherwise("remove").alias("action"),
            F.when(F.col("general"), F.concat("prefix", F.lit("*"))).otherwise(F.lit(PLACEHOLDER["term"])).alias("shown"),
        )
    )


def with_flags(scanned: DataFrame, flagged: DataFrame) -> DataFrame:
    """``scanned`` rows that name an entity with disclosing terms, and ``flags``: these terms and what is shown instead.

    Entities meet their terms by entity, texts meet what was found by row number; Spark broadcasts either side
    only where it is small.
    """
    terms = flagged.groupBy("entity").agg(F.collect_list(F.struct("term", "shown")).alias("terms"))
    of_row = scanned.select("row", F.explode("entities").alias("entity")).join(terms, "entity").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("flags"))
    return scanned.filter("size(entities) > 0").join(of_row, "row", "left")


def chosen(flags: list[dict] | None) -> dict[str, str]:
    """What is shown for each term: removal goes before a prefix."""
    shown: dict[str, str] = {}
    for f in flags or ():
        if shown.get(f["term"]) != PLACEHOLDER["term"]:
            shown[f["term"]] = f["shown"]
    return shown


_TERMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("shown", pa.string())]))


def find_spans(docs: DataFrame, *, window: int = 8, disclosure: float = 0.9, min_support: int = 3) -> DataFrame:
    """One row a document: counts, base spans, and the spans of terms that disclose its entities."""
    scanned = cut(scan_spans(docs, ["doc_id"], window), "pii-scan")
    flagged = cut(disclosing_terms(scanned, cut(term_counts(docs), "pii-counts"), disclosure=disclosure, min_support=min_support), "pii-flagged")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "end", "shown"), x)) for x in occurrences(t, base_spans(t), chosen(f))] for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _TERMS)], ["row", "terms"])

    named = with_flags(scanned.select("row", "entities", "named"), flagged).filter("flags is not null").select("row", "named", "flags")
    terms = named.mapInArrow(run, "row long, terms array<struct<start:long,end:long,shown:string>>")
    columns = [*(f"n_{k}" for k in KINDS), "base", "n_chars"]
    return (
        scanned.select("row", "doc.doc_id", *columns).join(terms, "row", "left")
        .withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start:long,end:long,shown:string>>)"))).drop("row")
    )


def sanitise(docs: DataFrame, *, window: int = 8, disclosure: float = 0.9, min_support: int = 3) -> DataFrame:
    """``docs`` with entities masked and the terms that disclose them generalised or removed in ``text``.

    Documents that name no entity leave as they were read; the others meet the terms of their entities by row.
    """
    scanned = cut(scan_spans(docs, docs.columns, window).drop("named"), "pii-scan")
    flagged = cut(disclosing_terms(scanned, cut(term_counts(docs), "pii-counts"), disclosure=disclosure, min_support=min_support), "pii-flagged")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            fields = list(doc.flatten())
            texts = [None if t is None else masked(t, f) for t, f in zip(fields[at].to_pylist(), batch.column(1).to_pylist())]
            fields[at] = pa.array(texts, doc.type.field(at).type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=[doc.type.field(i) for i in range(doc.type.num_fields)])], ["doc"])

    naming = with_flags(scanned.select("row", "entities", "doc"), flagged).select("doc", "flags")
    done = naming.mapInArrow(run, f"doc {scanned.schema['doc'].dataType.simpleString()}")
    other = scanned.filter("size(entities) = 0").select("doc")
    return other.unionByName(done).select("doc.*").to(docs.schema)


def masked(text: str, flags: list[dict] | None) -> str:
    """``text`` with its base spans replaced by a placeholder and its flagged terms by what is shown instead."""
    spans = base_spans(text)
    edits = [(s, e, PLACEHOLDER[k]) for k in KINDS for s, e in spans[k]]
    if flags:
        edits += occurrences(text, spans, chosen(flags))
    out, done = [], 0
    for start, end, put in sorted(set(edits), key=lambda x: (x[0], -x[1], x[2])):
        if start >= done:
            out += [text[done:start], put]
            done = end
        elif end > done:  # spans of two kinds overlap: the rest is covered by the same placeholder
            done = end
    out.append(text[done:])
    return "".join(out)
