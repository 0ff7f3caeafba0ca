"""Operators 1 and 9, the pipeline and the SQL of the queries."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import queries, quotes, url_rules

DATA = "/root/testdata/sf0.001"


def test_quotes_link_to_the_latest_earlier_origin(spark):
    rows = [
        (1, 0, "a", "Hello there\nsecond line"),
        (1, 1, "b", "> hello   there\n\nMy answer"),
        (1, 2, "c", "another thing"),
        (1, 3, "d", ">> Hello there\n> my answer\nDeep reply"),
        (1, 4, "e", "> unknown words\nnothing to link"),
        (2, 0, "a", None),
        (2, 1, "b", "> Hello there\nother conversation"),
        (None, None, None, ""),
        (3, 5, "x", "> self\nself"),
        (3, 5, "x", "> self\nself"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"own": F.lit(1), "depth": F.lit(2)})
    out = quotes.link_quotes(table).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 1].quoted_turn == 0 and by[1, 1].own == "My answer" and by[1, 1].n_linked == 1
    assert by[1, 3].quoted_turn == 1 and by[1, 3].depth == 2 and by[1, 3].n_linked == 2 and by[1, 3].own == "Deep reply"
    assert by[1, 4].quoted_turn is None and by[1, 4].parent_turn == 3
    assert by[2, 1].n_linked == 0 and by[2, 0].own == "" and by[3, 5].n_linked == 0
    order = [t for t, _ in sorted(((t, by[1, t].reply_order) for t in range(5)), key=lambda x: x[1])]
    assert order.index(3) == order.index(1) + 1  # the answer to turn 1 follows it
    assert quotes.link_quotes(table.limit(0)).count() == 0


def test_passages_of_several_lines_need_all_of_them(spark):
    rows = [
        (1, 0, "a", "Hi\nfirst thing\nsecond thing\nthird"),
        (1, 1, "b", "Hi\nsomething else"),
        (1, 2, "c", "> Hi\n> never written\nno origin"),
        (1, 3, "d", "> Hi\n> second thing\npart of it, but Hi came later elsewhere"),
        (1, 4, "e", "> first thing\n> second thing\nboth lines"),
        (1, 5, "f", "> Hi\none line"),
    ]
    out = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: out[t].quoted_turn for t in range(6)} == {0: None, 1: None, 2: None, 3: None, 4: 0, 5: 1}


def test_replies_follow_what_they_answer_at_any_depth(spark):
    def brute(parents):
        """Preorder: what quotes a turn first, then the turn after it."""
        below = {t: sorted((c for c, p in parents.items() if p == t), key=lambda c: (t is not None and c == t + 1, c)) for t in [None, *parents]}
        out, open_ = [], below[None][::-1]
        while open_:
            out.append(open_.pop())
            open_ += below[out[-1]][::-1]
        return out

    r = random.Random(6)
    talks = {1: {2: 0, 3: 1, 4: 2}, 2: {}, 3: {t: t - 2 for t in range(2, 20)}}
    for conv in range(4, 14):
        talks[conv] = {t: r.randrange(t) for t in range(1, 25) if r.random() < 0.6}
    rows, expected = [], {}
    for conv, quotes_of in talks.items():
        n = 25 if conv > 3 else 20 if conv == 3 else 5
        rows += [(conv, t, "u", f"> words {quotes_of[t]}\n\nwords {t}" if t in quotes_of else f"words {t}") for t in range(n)]
        parents = {t: quotes_of.get(t, t - 1 if t else None) for t in range(n)}
        expected[conv] = (parents, brute(parents))
    assert expected[1][1] == [0, 2, 4, 1, 3]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(rows)
    for conv, (parents, order) in expected.items():
        mine = sorted((x for x in found if x.conv_id == conv), key=lambda x: x.reply_order)
        assert {x.turn: x.parent_turn for x in mine} == parents
        assert [x.turn for x in mine] == order
        for x in mine:  # from each turn on the path, the next one is reached backwards turn by turn, then by one answer
            chain, at = [x.turn], x.turn
            while parents[at] is not None:
                if parents[at] != at - 1:
                    chain.insert(0, parents[at])
                at = parents[at]
            assert x.reply_path == chain


def test_listed_rules_and_parts_of_urls(spark):
    urls = [
        "http://A.Example.NET/en/x?q=1#f", "https://example.net/enx", "http://foo.example.com/de/1", "http://bar.org/fr/", "http://net/", "http://x.net", "http://notnet/",
        "no scheme.net/", None, "", "x://y.example.com?z/de/", "http://h.net/a://b.org/fr/",
    ]
    pages = spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "verdict": F.lit(1)})
    none = spark.createDataFrame([], "page_id long, unwanted boolean")
    out = {r.page_id: r for r in url_rules.filter_urls(pages.select("page_id", "url"), none).collect()}
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[1].rule, out[1].verdict) == ("net/", "block")
    assert (out[2].rule, out[2].verdict) == ("example.com/de/", "block")
    assert (out[3].rule, out[4].rule) == ("org/fr/", "net/")
    assert out[5].rule is None and out[5].path == "" and out[6].rule is None
    assert all((out[i].host, out[i].path, out[i].rule, out[i].verdict) == ("", "", None, "allow") for i in (7, 8, 9))
    assert (out[10].host, out[10].path) == ("y.example.com", "") and out[11].rule == "net/"
    assert url_rules.filter_urls(pages.select("page_id", "url").limit(0), none).count() == 0


def test_association_rules_block_and_are_pruned(spark):
    pages = [(i, f"http://shop{i % 7}.com/{'deal' if i % 4 == 0 else 'news'}/{i}?ref={i}") for i in range(400)]
    labels = [(i, i % 4 == 0) for i in range(0, 400, 3)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (None, True), (3, None)], "page_id long, unwanted boolean")
    out = {r.page_id: r for r in url_rules.filter_urls(table, marks, rules=[]).collect()}
    assert len(out) == 400 and all((out[i].verdict == "block") == (i % 4 == 0) for i in range(400))
    cut = url_rules.url_tokens(url_rules.host_and_path(table)).join(marks.where("unwanted is not null"), "page_id")
    mined = url_rules.mine_rules(cut.select("tokens", "unwanted"), 0.001, 0.5).collect()
    assert [r.rule_tokens for r in mined if r.confidence == 1.0] == [["path=deal"]]


def test_rules_on_the_last_parts_of_long_urls(spark):
    path = "/".join(f"part{chr(97 + k)}" for k in range(20))
    keys = "&".join(f"k{k}=1" for k in range(20))
    pages = [(i, f"http://a.b.c.shop{i % 7}.com/{path}/{'deal' if i % 4 == 0 else 'news'}?{keys}{'&spam=1&junk=2' if i % 4 == 1 else ''}") for i in range(400)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([(i, i % 4 < 2) for i in range(0, 400, 3)], "page_id long, unwanted boolean")
    out = {r.page_id: r.verdict for r in url_rules.filter_urls(table, marks, rules=[], min_confidence=0.9).collect()}
    assert len(out) == 400 and all((out[i] == "block") == (i % 4 < 2) for i in range(400))
    cut = url_rules.url_tokens(url_rules.host_and_path(table)).join(marks, "page_id")
    mined = url_rules.mine_rules(cut.select("tokens", "unwanted"), 0.001, 0.9).collect()
    assert sorted((r.rule_tokens, r.key) for r in mined) == [([t], t) for t in ("path=deal", "query=junk", "query=spam")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    expected = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    rows = [f[columns].astype(str).sort_values(columns).to_numpy().tolist() for f in (expected, got)]
    assert rows[0] == rows[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
    assert 0 < sizes[3] <= sizes[2] <= sizes[1] <= sizes[0]
    assert corpus_pipeline.run(spark, DATA).count() == sizes[4]


def test_pipeline_stages_match_plain_python(spark):
    """Each stage but the first, which is a model, on a small table: what stays, and the texts that are left."""
    import corpus_pipeline as cp

    from test_documents import SCHEMA, prose, shingle_set, words_in_passages

    shared, leak = prose(70, 60), prose(71, 30)
    texts = [prose(k, 80) for k in range(12)]
    texts += [texts[0], texts[1] + " end", texts[2].upper(), f"{prose(80, 40)} {shared} {prose(81, 20)}", f"{prose(82, 9)} {shared}", shared + " x", f"{prose(83, 30)} {leak[: len(leak) // 2]} {prose(84, 30)}", None, "", "word"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(cp.STAGES)

    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    near = stages["n-gram Jaccard join"](spark, docs, DATA)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(set(label)) and len(set(label)) == len(texts) - 4

    pairs = [(i, t) for i, t, *_ in rows]
    cut = {r.doc_id: r for r in stages["suffix-array dedup"](spark, docs, DATA).collect()}
    for (i, t), gone in zip(pairs, words_in_passages(pairs, 50), strict=True):
        left = [w for p, w in enumerate((t or "").split()) if p not in gone]
        if gone:
            assert (i in cut) == bool(left) and (not left or cut[i].text.split() == left and cut[i].n_chars == len(cut[i].text))
        else:
            assert cut[i].text == t
