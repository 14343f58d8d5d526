"""Near vectors against all pairs, extraction on known pages, and the pipeline's stages."""

import importlib

import numpy as np
import pytest

from twinlink.llm import cap_filters, html_text, queries

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, least=0.95):
    units = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            x /= np.abs(x).max()
            units[i] = x / np.linalg.norm(x)
    links = {i: [j for j in units if j != i and len(units[i]) == len(units[j]) and (units[i] @ units[j] >= least or rows[i][1] == rows[j][1])] if i in units else [] for i in range(len(rows))}
    out, component = [], {}
    for i in range(len(rows)):
        if i not in component:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            component.update({j: min(ids) if ids else None for j in group})
        out.append((rows[i][0], len(links[i]), component[i], rows[i][0] == component[i]))
    return sorted(out, key=repr)


def test_query_on_embeddings(spark):
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = queries.op7_cap_filter_near_dedup(spark, SF_DIR).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute(data)


def test_links_near_the_limit(spark):
    """Pairs at a cosine of just 0.95 and above are found nearly always, and chains are followed."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(500):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9501 + 0.04 * rng.random()
        rows += [(2 * k, x.astype(np.float32).tolist()), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).astype(np.float32).tolist())]
    out = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(r.n_links <= want[r.vec_id] for r in out)
    assert sum(r.n_links for r in out) >= 0.995 * sum(want.values())


def test_odd_vectors(spark):
    v = [0.1 * i for i in range(1, 9)]
    rows = [
        (5, v), (3, v), (3, v), (None, v), (9, [x * 3 for x in v]), (1, None), (2, [0.0] * 8), (4, [float("nan")] + v[1:]), (6, [float("inf")] + v[1:]),
        (7, [None] + v[1:]), (8, []), (10, v[:4]), (11, [1e300 * x for x in v]), (12, [1e-300 * x for x in v]), (None, [-x for x in v]), (13, [2.0]), (14, [3.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, kept string, h1 int")
    got = sorted(map(tuple, cap_filters.near_vectors(df).collect()), key=repr)
    assert got == brute(rows)
    assert cap_filters.near_vectors(df.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>A title &amp; more</h1><p>First <b>bold</b>,
 with&nbsp;a   <a href="/x">link</a>.<br>Line two &#233;.<p>Second one, long enough to be a text of its own.</p></article>
<div class="cookie-notice">We use cookies.</div><section class="comments"><p>Nice post!</p><p>I agree.</p></section>
<form><label>Name</label><input name="n"><p>Send</p></form><footer>&copy; someone</footer>"""


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


def test_extraction(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "v", "just text"), (3, "v", "<p" + "x" * 50_000), (4, "w", "<script>never closed <p>no</p>"), (5, "z", "<nav>" * 2000 + "a")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.main_text(df, labeller).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r.text for r in got if r.page_id in (1, 2, 4)}
    assert by_id[1] == "A title & more First bold, with a link. Line two é. Second one, long enough to be a text of its own."
    assert by_id[2] == "" and by_id[4] == ""
    assert html_text.main_text(df.where("false"), labeller).count() == 0


def test_articles_of_all_pages(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages, labeller).collect()}
    right = 0
    for r in pages.collect():
        inner = [b.text for b in html_text.blocks(r.html) if "article" in b.path]
        right += got[r.page_id] == " ".join(inner)
    assert right >= 0.98 * len(got)


def test_unseen_templates(labeller):
    rng = np.random.default_rng(11)
    texts = ["Some words that stand in a paragraph of a page.", "Others, that are a little longer, say more; they end here.", "Short one."]
    right = blocks = 0
    for _ in range(200):
        page, labels = html_text.training_page(rng, texts)
        found = html_text.blocks(page)
        if len(found) == len(labels):
            right += (labeller.label([html_text.features(found)])[0] == np.array(labels)).sum()
            blocks += len(labels)
    assert right >= 0.95 * blocks


def test_gradients(labeller):
    """Back-propagation agrees with differences of the loss."""
    rng = np.random.default_rng(0)
    model = html_text.Labeller(rng)
    for p in model.parameters():
        p += rng.standard_normal(p.shape).astype(np.float32) * 0.1
    x = rng.standard_normal((5, 3, html_text.FEATURES)).astype(np.float32)
    mask = np.ones((5, 3), dtype=np.float32)
    mask[3:, 1] = 0
    y = rng.integers(0, 2, (5, 3)).astype(np.float32)

    def loss():
        logits, _ = model.logits(x.astype(np.float64), mask)
        return float((mask * (np.logaddexp(0, logits) - y * logits)).sum() / mask.sum())

    for p, g in zip(model.parameters(), model.gradients(x, mask, y)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[at]
        p[at] = old + 1e-3
        high = loss()
        p[at] = old - 1e-3
        assert (high - loss()) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-3)
        p[at] = old


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF_DIR)
        assert out.columns == columns and out.schema == kept.schema, name
        rows = out.collect()
        kept = spark.createDataFrame(rows, out.schema)
    last = pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    whole = pipeline.run(spark, SF_DIR)
    assert sorted((r.doc_id, list(r.ids)) for r in last.collect()) == sorted((r.doc_id, list(r.ids)) for r in whole.collect())
    assert 0 < whole.count() < docs.count()
