import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda s: re.sub("[^0-9]", "", s)


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and plain_luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab@.+-_ 0123459()é\n", max_size=60))
def test_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 3000, "1." * 100_000, "a@" * 100_000, "+1" + "(" * 200_000):
        pii.base_spans(text)
    assert pii.base_spans("1.2.3." + "0" * 5000)["ip"] == [(0, 5006)] and not pii.base_spans("1.2.3." + "9" * 5000)["ip"]


def test_query_on_odd_rows(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(odd_rows)
    base = {(r["doc_id"], r["base_sha256"]) for r in got}
    for row in odd_rows:
        spans = plain(row[1] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in spans[k])
        assert (row[0], hashlib.sha256(listed.encode()).hexdigest()) in base


def docs_with_an_entity(spark):
    words = "alpha beta gamma delta kappa omega sigma theta".split()
    rows = [(i, f"{words[i]} note {words[-i]} about zorblax ask bob@example.com for {words[i]} {i} thing") for i in range(6)]
    rows += [(100 + i, f"other note {i} about nothing thing for us all {words[i % 8]}") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_term_that_reveals_an_entity_is_found(spark):
    found = pii.find_spans(docs_with_an_entity(spark)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs_with_an_entity(spark).collect()}
    terms = {texts[r["doc_id"]][t["start"] : t["end"]] for r in found for t in r["terms"]}
    assert terms == {"zorblax", "ask"}
    assert all(not r["terms"] for r in found if r["doc_id"] >= 100)


def test_one_passage_copied_is_no_evidence(spark):
    rows = [(i, "unusual zorblax words near bob@example.com today") for i in range(50)] + [(100 + i, f"plain {i}") for i in range(100)]
    assert all(not r["terms"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_sanitise(spark, odd_docs, no_docs):
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs_with_an_entity(spark)).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[100].startswith("other note 0")
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[9] == "mail [EMAIL] or [PHONE] or 10.0.0.300 and [CARD]!" and texts[0] is None and texts[1] == ""
    assert pii.sanitise(no_docs).count() == 0 and pii.find_spans(no_docs).count() == 0


def test_words_within_the_window_however_far():
    text = "zorblax " + "12 " * 200 + "bob@example.com" + " 7" * 300 + " " + "q" * 300 + " end"
    got = {(t, s, e) for _, t, _, s, e in pii.contexts(text, pii.base_spans(text), 8)}
    assert got == {(t, text.index(t), text.index(t) + len(t)) for t in ("zorblax", "q" * 300, "end")}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé@. 1+_", max_size=80), st.integers(1, 3))
def test_contexts_are_the_nearest_words(text, window):
    spans = pii.base_spans(text)
    marked = [x for k in pii.KINDS for x in spans[k]]
    want = set()
    for s, e in marked:
        near = [m.span() for m in pii._TERM.finditer(text, 0, s)][-window:] + [m.span() for m in pii._TERM.finditer(text, e)][:window]
        want |= {(a, b) for a, b in near if not any(a < y and x < b for x, y in marked)}
    assert {(s, e) for *_, s, e in pii.contexts(text, spans, window)} == want


def plain_terms(rows, window=8, disclosure=0.9, min_support=3):
    """(doc_id, start, end, shown) of every disclosing term, counted over all rows in plain loops."""
    from collections import Counter, defaultdict
    from math import log2

    word = re.compile(r"[^\W\d_]{3,}")
    entities, df, df_e, co, passages = {}, Counter(), Counter(), Counter(), defaultdict(set)
    for i, (_, text) in enumerate(rows):
        df.update({w.lower() for w in word.findall(text)})
        spans = [(k, s, e) for k, xs in plain(text).items() for s, e in xs]
        key = lambda k, s, e: f"{k}:{text[s:e].lower() if k == 'email' else text[s:e] if k == 'ip' else digits(text[s:e])}"  # noqa: B023, E731
        entities[i] = {key(*x) for x in spans}
        df_e.update(entities[i])
        seen = set()
        for k, s, e in spans:
            near = [m.span() for m in word.finditer(text, 0, s)][-window:] + [m.span() for m in word.finditer(text, e)][:window]
            words = [text[a:b].lower() for a, b in near if not any(a < y and x < b for _, x, y in spans)]
            seen |= {(key(k, s, e), w, tuple(words)) for w in words}
        co.update((e, t) for e, t, _ in seen)
        for e, t, p in seen:
            passages[e, t].add(p)
    n, shown = len(rows), defaultdict(dict)
    reveals = lambda c, d, e: log2(n * min(c, d) / (d * df_e[e])) >= disclosure * log2(n / df_e[e])
    for (e, t), c in co.items():
        if len(passages[e, t]) >= min_support and n > df_e[e] and reveals(c, df[t], e):
            group = sum(d for w, d in df.items() if w[:3] == t[:3])
            shown[e][t] = "[REMOVED]" if reveals(c, group, e) else t[:3] + "*"
    out = []
    for i, (doc_id, text) in enumerate(rows):
        put = {}
        for e in entities[i]:
            for t, x in shown[e].items():
                put[t] = x if put.get(t) != "[REMOVED]" else put[t]
        spans = [x for xs in plain(text).values() for x in xs]
        left = "".join(" " if any(s <= k < e for s, e in spans) else c for k, c in enumerate(text))
        out += [(doc_id, m.start(), m.end(), put[m.group().lower()]) for m in word.finditer(left) if m.group().lower() in put]
    return sorted(out)


def random_docs(seed):
    import random

    r = random.Random(seed)
    common = ["alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "theta", "alps", "betray", "gamble"]
    people = [("ann@x.example", ["zorblax", "quibble"]), ("+1 555 123 4567", ["zorblax", "alphorn"]), ("10.1.2.3", ["betatron", "gamut", "Zorbing"])]
    rows = []
    for i in range(160):
        words = [r.choice(common) for _ in range(r.randrange(3, 40))]
        if r.random() < 0.35:
            for entity, terms in r.sample(people, r.choice([1, 1, 2])):
                words.insert(r.randrange(len(words) + 1), " ".join([r.choice(terms), r.choice(common), entity, r.choice(terms)]))
                words += [r.choice(common)] * 9 + [r.choice(terms)]
        rows.append((i, " ".join(words)))
    return rows


def test_terms_are_those_of_a_plain_count(spark):
    kinds = set()
    for seed in range(3):
        rows = random_docs(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["doc_id"], t["start"], t["end"], t["shown"]) for r in pii.find_spans(docs).collect() for t in r["terms"])
        want = plain_terms(rows)
        assert got == want
        kinds |= {x[3][-1] for x in want}
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
        for doc_id, s, e, _ in want:
            assert not re.search(rf"\b{dict(rows)[doc_id][s:e]}\b", clean[doc_id])
    assert kinds == {"]", "*"}


def test_thousands_of_spans_in_one_text(spark):
    from time import perf_counter

    text = " ".join(f"name{i} person{i}@mail{i % 7}.example phone number" for i in range(30_000))
    begin = perf_counter()
    spans = pii.base_spans(text)
    assert len(spans["email"]) == 30_000
    assert len(pii.contexts(text, spans, 8)) > 290_000
    assert len(pii.occurrences(text, spans, {"phone": "x"})) == 30_000
    assert perf_counter() - begin < 20
    rows = [(1, text), (2, "plain")]
    assert pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_email = 30000").count() == 1


def test_sanitise_without_doc_ids(spark):
    docs = docs_with_an_entity(spark)
    nameless = docs.selectExpr("cast(null as bigint) as doc_id", "text")
    assert sorted(r["text"] for r in pii.sanitise(nameless).collect()) == sorted(r["text"] for r in pii.sanitise(docs).collect())
    assert not any("zorblax" in r["text"] for r in pii.sanitise(nameless).collect())
