"""What queries write, read and run again as their tables grow."""

import glob
import os
import random

from pyspark.sql import functions as F

from tessera.operators import markdown, ranks, schema, states
from tessera.plans import import_queries
from tessera.sources import cursors
from tessera.sources import registry as sources


def test_markdown_packs_hold_many_files(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(import_queries, "_scratch", lambda s: str(tmp_path / "tree"))
    assert import_queries.src16_markdown_files(spark, small).count() > 100
    folders = {os.path.dirname(f) for f in glob.glob(f"{tmp_path}/tree/**/*.*", recursive=True)}
    assert len(folders) <= 10  # one for each space and kind, and not one a document


def test_markdown_packs_read_as_single_files(spark, tmp_path):
    rows = [(["a b", "x+y%", "de"][i % 3], "drafts" if i % 4 == 3 else "pages", f"n {i}.md", f"---\nk: {i}\n---\n# T{i}\n" + "text\n" * (i % 3)) for i in range(60)]
    files = spark.createDataFrame(rows, "space string, kind string, file string, text string")
    sources.write_markdown_packs(files, str(tmp_path / "packs"), "space", "kind")
    rules = ["kind=drafts/", "space=de/", "n 4*", "!n 48.md"]
    for space, kind, file, text in rows:
        folder = tmp_path / "single" / f"space={space.replace('%', '%25')}" / f"kind={kind}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / file).write_text(text)
    single, packed = sources.load(spark, "markdown", str(tmp_path / "single"), ignore=rules), sources.load(spark, "markdown-packs", str(tmp_path / "packs"), ignore=rules)
    plain = lambda df: sorted((r["title"], r["body"], tuple(r["frontmatter"].items())) for r in df.collect())
    assert plain(packed) == plain(single) and 0 < packed.count() < 60
    assert packed.filter(F.col("path") == "space=a b/kind=pages/n 48.md").count() == 1
    everything = sources.load(spark, "markdown-packs", str(tmp_path / "packs"))
    assert everything.count() == 60


def test_trees_are_read_once_for_all_rules(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    tree = '{"type":"doc","version":1,"content":[{"type":"heading","attrs":{"level":9},"odd":1},{"type":"glow","marks":[{"type":"shine"}]}]}'
    docs = spark.createDataFrame([(i, tree) for i in range(7)], "doc_id long, t string")
    found = schema.violations(schema.tree_rows(docs.mapInArrow(counted, docs.schema), "t"))
    assert found.count() == 28 and read.value == 7


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_gather_no_values(spark):
    for values in ([5.0], [1.0, 2.0], [3.0, 1.0, None, 3.0, 3.0, 8.0], [float(i * 37 % 101) for i in range(2000)], [7.0] * 99 + [9.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for p in (0.0, 0.3, 0.5, 0.95, 1.0):
            want = df.agg(F.expr(f"percentile_cont({p}) within group (order by x)"), F.expr(f"percentile_disc({p}) within group (order by x)"), F.max("x")).first()
            found = ranks.quantiles(df, "x", a=("cont", p), b=("disc", p))
            assert all(abs(a - b) < 1e-9 for a, b in zip(found.first(), want)), (values[:5], p)
    assert "percentile" not in plan(found)
    assert tuple(ranks.quantiles(df.limit(0), "x", a=("cont", 0.5)).first()) == (None, None)


def test_long_cursors_are_folded(spark, monkeypatch):
    doubled = []
    walked = cursors._walked
    monkeypatch.setattr(cursors, "_walked", lambda reached, links: doubled.append(links.count()) or walked(reached, links))
    r = random.Random(5)
    order = list(range(900))
    r.shuffle(order)
    chain = [(str(a), str(b)) for a, b in zip(order, order[1:])]
    aside = [(f"x{i}", str(r.choice(order))) for i in range(200)] + [(f"s{i}", f"s{i}") for i in range(200)] + [(f"y{i}", f"y{i ^ 1}") for i in range(200)]
    for last in ((str(order[-1]), None), (str(order[-1]), "gone"), (str(order[-1]), str(order[450])), (str(order[-1]), str(order[0]))):
        edges, at, want = dict([*chain, last, *aside]), str(order[7]), []
        while at in edges and at not in dict((t, 0) for t, _ in want):
            want.append((at, len(want)))
            at = edges[at]
        end = "last" if at is None else "missing" if at not in edges else "loop"
        got = cursors.drained(spark.createDataFrame(list(edges.items()), "token string, next_token string"), str(order[7]), few=60).collect()
        assert sorted((r["place"], r["token"], r["state"]) for r in got) == [(i, t, "more" if i + 1 < len(want) else end) for t, i in want]
    assert max(doubled) <= 60


def test_includes_of_cyclic_pages_in_few_rounds(spark, monkeypatch):
    rounds, kept = [0], states.stored
    monkeypatch.setattr(states, "stored", lambda df: rounds.__setitem__(0, rounds[0] + 1) or kept(df))
    r = random.Random(3)
    edges = {i: [i + 1, *(r.randrange(60) for _ in range(r.randrange(2)))] for i in range(40)} | {i: [i + 1] for i in range(40, 59)} | {59: [59, 40, None], 70: []}
    got = states.expand_includes(spark.createDataFrame(list(edges.items()), "page_id int, includes array<int>")).collect()
    want = {}
    for page in edges:
        level, depth = {page}, 0
        while level:
            depth += 1
            level = {x for v in level for x in edges.get(v, []) if x is not None and x != page and (page, x) not in want}
            want |= {(page, x): depth for x in level}
    assert len(got) == len(want) and {(r["page_id"], r["include"]): r["depth"] for r in got} == want
    assert rounds[0] < max(want.values())


def test_texts_are_exchanged_once_to_markdown(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id long, storage string")
    moved = [x for x in plan(markdown.to_markdown(pages, "storage")).split("== Initial Plan ==")[0].split("\n") if "Exchange" in x]
    assert moved and len([x for x in moved if "REPARTITION_BY_COL" in x]) == 1
    said = '<p>x</p><ac:structured-macro ac:name="code"><ac:parameter ac:name="language">p<![CDATA[y]]></ac:parameter><ac:plain-text-body><![CDATA[z]]></ac:plain-text-body></ac:structured-macro>'
    assert markdown.to_markdown(spark.createDataFrame([(1, said)], "page_id long, storage string"), "storage").first()["markdown"].count("z") == 1
