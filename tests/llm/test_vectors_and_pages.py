"""Operators on vectors and pages against brute force, and the pipeline, on small tables."""

import hashlib
import html
import re

import numpy as np
import pytest

from estimora.llm import html_main, near_vectors, warc
from estimora.llm.components import connected


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (7, 8), (8, 7)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {v: c for v, c in label.items() if v != c}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_by_force(rows):
    sound = {k: np.array(e, float) for k, (_, e, label) in enumerate(rows) if e and label is not None and None not in e and np.isfinite(e).all() and any(e)}
    links = {k: set() for k in range(len(rows))}
    for a in sound:
        for b in sound:
            if a != b and rows[a][2] == rows[b][2] and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= 0.93:
                links[a].add(b)
    label = {k: rows[k][0] for k in links}
    for _ in range(len(rows)):
        new = {k: min([label[k], *(label[j] for j in links[k])]) for k in links}
        if new == label:
            break
        label = new
    return sorted((rows[k][0], len(links[k]), label[k], rows[k][0] == label[k]) for k in links)


@pytest.mark.parametrize("cell, block, most", [(2000, 2000, 4096), (8, 5, 4096), (8, 3, 6), (30, 4, 4096)])
def test_near_vectors(spark, monkeypatch, cell, block, most):
    """Also with cells and blocks so small that there are many of them."""
    monkeypatch.setattr(near_vectors, "CELL_ROWS", cell)
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_vectors, "MOST_PIVOTS", most)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 6))
    rows = [(k, (centers[k % 12] + rng.normal(size=6) * 0.25).astype("f4").tolist(), k % 3) for k in range(150)]
    rows += [(200 + k, rows[0][1], 0) for k in range(9)] + [(300, [0.0] * 6, 0), (301, None, 0), (302, [float("nan")] * 6, 0), (303, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (304, rows[0][1], None), (305, [float("inf")] + [1.0] * 5, 1), (306, [], 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, cell int")
    found = sorted(tuple(r) for r in near_vectors.near_classes(table).collect())
    assert found == vectors_by_force(rows)
    assert near_vectors.near_classes(table.limit(0)).count() == 0
    nameless = near_vectors.near_classes(table.selectExpr("CASE WHEN vec_id > 203 THEN vec_id END AS vec_id", "embedding", "label")).filter("vec_id IS NULL OR vec_id = 204").collect()
    assert {tuple(r) for r in nameless} == {(None, 0, None, False), (204, 4, 204, True)}


PAGES = [(1, "http://a.b/1", "x" * 150), (2, "http://a.b/2", "x" * 150), (3, None, "x" * 150), (4, "http://a.b/4", None), (5, "bad url \n x", ""), (6, "http://a.b/6", "short"), (7, "http://a.b/7", "short"), (8, "http://c/8", "é" * 60), (9, "http://c/9", "é" * 60), (10, "http://c/10", "<p>" + "long " * 600_000)]


def test_warc(spark):
    table = spark.createDataFrame([(*p, "z", 0) for p in [*PAGES, PAGES[0], PAGES[1]]], "page_id long, url string, html string, digest string, refers_to long")
    found = sorted(map(tuple, warc.archived(table).collect()), key=str)
    first, expected = {}, []
    for i, _, h in PAGES:
        b = (h or "").encode()
        digest = hashlib.sha256(b).hexdigest()
        origin = first.setdefault(digest, i) if len(b) >= 100 else i
        expected += [(i, len(b), digest, "response" if origin == i else "revisit", None if origin == i else origin)] * (2 if i < 3 else 1)
    assert found == sorted(expected, key=str)
    assert warc.archived(table.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archived(spark.createDataFrame([(None, None, "n" * 200), (None, None, "n" * 200)], "page_id long, url string, html string")).collect()} == {"response"}


def records_of(data):
    """A reader of WARC 1.1 of its own: fields and block of each record, by the grammar of the standard."""
    found, at = [], 0
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at + 10 : end].split(b"\r\n"):
            m = re.fullmatch(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)", line)
            fields[m[1].decode().lower()] = m[2].decode()
        size = int(fields["content-length"])
        found.append((fields, data[end + 4 : end + 4 + size]))
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n"
        at = end + 8 + size
    return found


def test_records_are_valid(spark, tmp_path):
    """Mandatory fields, unique ids, digests and references, read record by record from the plain bundles."""
    import zstandard

    rows = [*PAGES, PAGES[0], PAGES[1], (None, "http://n/", "n" * 200), (None, "http://n/", "n" * 200)]
    index = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path)).collect()
    every = []
    for name in {r["name"] for r in index}:
        with open(tmp_path / name, "rb") as f:
            every += records_of(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read())
    assert len(every) == len(rows) and len({f["warc-record-id"] for f, _ in every}) == len(rows)
    assert {f["warc-record-id"] for f, _ in every} == {r["record_id"] for r in index}
    by_id = {f["warc-record-id"]: f for f, _ in every}
    for f, block in every:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["warc-record-id"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["warc-date"])
        assert f["warc-type"] in ("response", "revisit") and re.fullmatch(r"[!-~]+", f["warc-target-uri"]) and f["content-type"] == "application/http; msgtype=response"
        head, _, payload = block.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK\r\n") and f["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        if f["warc-type"] == "response":
            assert f["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest() and int(head.split(b"Content-Length: ")[1]) == len(payload)
        else:
            assert f["warc-profile"] == warc.PROFILE and not payload
            if "warc-refers-to" in f:
                assert by_id[f["warc-refers-to"]]["x-page-id"] == f["x-refers-to-page-id"] and by_id[f["warc-refers-to"]]["warc-payload-digest"] == f["warc-payload-digest"]
    assert sum("warc-refers-to" in f for f, _ in every) == 1 and sum(f["warc-type"] == "revisit" for f, _ in every) == 4


def test_seek_table(tmp_path):
    """The bundle is a plain Zstandard file for any other reader, too."""
    import pyarrow.fs as fs
    import zstandard

    local = fs.LocalFileSystem()
    writer = warc.BundleWriter(local.open_output_stream(str(tmp_path / "b"), compression=None))
    records = [bytes([65 + k]) * 300_000 for k in range(9)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = warc.BundleReader(local.open_input_file(str(tmp_path / "b")))
    assert len(reader.places) == 3 and [reader.record(f, o, 300_000) for f, o in reversed(places)] == records[::-1]
    with open(tmp_path / "b", "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(records)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- x -->
<article class="post"><header><h1>Title &amp; more</h1></header><p>First<br>line <b>bold<i>er</i></b>,
 ok.<p>Second &eacute;&#8212;x</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><aside>side</aside><div class="ad">buy</div>
<form><input name=a>send</form><section id="comments"><article>me too</article></section><p hidden>no</p></article>
<div class="sidebar">related</div><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more\n\nFirst line bolder, ok.\n\nSecond é—x\n\none\n\ntwo\n\nc1\n\nc2"
    pages = [(1, "http://h/1", PAGE), (2, None, None), (3, "http://h/3", ""), (4, "nonsense", "just text"), (5, "http://h/5", "<body><nav>m</nav><div><p>Body only</div><p>end"), (6, "http://h/6", "<p>a < b & c</p><p title='x>y'>d"), (1, "http://h/1", PAGE)]
    table = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    found = {r["page_id"]: r["text"] for r in html_main.extracted(table).collect()}
    assert found == {1: want, 2: "", 3: "", 4: "just text", 5: "Body only\n\nend", 6: "a < b & c\n\nd"}
    assert all(r["n_chars"] == len(r["text"]) for r in html_main.extracted(table).collect())
    assert html_main.extracted(table).count() == 7 and html_main.extracted(table.limit(0)).count() == 0


def test_style_tree_finds_what_repeats(spark):
    """A box without a telling name, the same on a host's pages, goes; the articles stay, copies too."""
    page = lambda k: f'<body><div class="x1">Buy now at our shop</div><main><p>Text {k} of its own</p><div class="q">Same words everywhere</div><p>End {k * 7}</p></main></body>'
    rows = [(k, f"http://h.example/{k}", page(k if k > 5 else 0)) for k in range(60)]
    found = {r["page_id"]: r["text"] for r in html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: f"Text {k if k > 5 else 0} of its own\n\nEnd {(k if k > 5 else 0) * 7}" for k in range(60)}


def test_main_text_of_the_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_main.extracted(table).collect()}
    for r in table.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert found[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_stages_on_odd_tables(spark):
    """Null and repeated ids, repeated rows, columns with the names of internal ones, and no rows at all."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    item = next(r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if r["text"])
    story = lambda k: " ".join(f"word{k}x{chr(97 + j % 26)}{j}" for j in range(30))
    rows = [
        (1, story(1)), (1, story(1)), (1, story(2)), (2, story(2) + " more"), (None, story(1)), (None, story(3)), (None, story(3)), (5, story(3) + " end"), (7, story(7)),
        (None, f"{story(8)} {item} {story(9)}"), (9, f"{story(10)} {item} {story(11)}"), (10, ""), (11, None), (12, None), (None, "12 !"), (13, f"{story(12)} mail me at a.b@c.de"), (None, f"{story(13)} at a.b@c.de"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row_key string, component_id long, extra map<string,int>"
    docs = spark.createDataFrame([(i, t, "en", "s", k, 0.25, "x", "y", -1, {"a": k}) for k, (i, t) in enumerate(rows)], schema)
    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    stages = dict(p.STAGES)
    left = stages["language"](spark, docs, d)
    assert plain(left) == sorted((r for r in rows if r[1] not in ("", None, "12 !")), key=str)
    assert {(r["score"], r["lang_pred"], r["row_key"], r["component_id"]) for r in left.collect()} == {(0.25, "x", "y", -1)}
    once = stages["near_duplicates"](spark, docs, d)
    # one of each class: of story 1 and 3 the row with the smallest id, of story 2 the row of id 1
    gone = [(1, story(1)), (None, story(1)), (2, story(2) + " more"), (None, story(3)), (None, story(3))]
    expected = list(rows)
    for r in gone:
        expected.remove(r)
    assert plain(once) == sorted(expected, key=str) and once.columns == docs.columns
    assert sorted(r["n_chars"] for r in once.collect() if r["text"] == story(1)) == [0]
    assert plain(stages["decontamination"](spark, docs, d)) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    masked = stages["personal_data"](spark, docs, d)
    assert sum("[EMAIL]" in (t or "") for _, t in plain(masked)) == 2 and masked.columns == docs.columns
    assert stages["token_ids"](spark, docs, d).count() == len(rows)
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name


def test_pipeline(spark):
    """Each stage keeps and changes what brute force says, and the columns of documents stay."""
    import corpus_pipeline as p
    from estimora.llm import decontaminate, jaccard, pii

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").unionByName(spark.createDataFrame([(10_001, None, None, None, None), (10_002, "123 !!", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long"))
    at = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, at, d)
        assert after.columns == docs.columns, name
        before, ids = {r["doc_id"]: r for r in at.collect()}, {r["doc_id"] for r in after.collect()}
        if name == "language":
            assert set(before) - ids == {10_001, 10_002}
        elif name == "near_duplicates":
            assert ids == {r["doc_id"] for r in jaccard.classes(at).collect() if r["doc_id"] == r["component_id"]} and len(ids) < len(before)
        elif name == "decontamination":
            assert set(before) - ids == {r["doc_id"] for r in decontaminate.contaminated(at, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
        else:
            field = pii.fit(at)
            assert all(r["text"] == pii.masked(before[r["doc_id"]]["text"], field) and r["n_chars"] == len(r["text"]) for r in after.collect())
        at = spark.createDataFrame(after.collect(), docs.schema)
    from pathlib import Path

    from estimora.llm.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert p.run(spark, d).count() == at.count()
    # but for the table that the result is read from and the prepared benchmark nothing is left
    assert sorted(f.name.split("-")[0] for f in set(folder.iterdir()) - before) == ["benchmark", "personal_data"]
