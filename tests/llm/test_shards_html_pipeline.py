import os

import duckdb
import pytest

import corpus_pipeline
from oracle import rows_of
from skytriage.llm import html_text, sharding
from skytriage.llm.html_text import visible_text
from skytriage.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", [500, 60000, sharding.MAX_BYTES])
def test_shards_against_duckdb(spark, limit):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sharding.assign(spark.read.parquet(f"{SF}/documents.parquet"), limit)
    cur = con.execute(sharding.ORACLE_SQL.replace(str(sharding.MAX_BYTES), str(limit)))
    cols = [c[0] for c in cur.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(cols, cur.fetchall())


def test_shards_of_odd_rows_fit_or_are_marked(odd, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 2)
    got = sharding.assign(odd, 700).collect()
    assert len(got) == odd.count()
    size, rows = {}, {}
    for r in got:
        size[r["shard_id"]] = size.get(r["shard_id"], 0) + r["n_bytes"]
        rows[r["shard_id"]] = rows.get(r["shard_id"], 0) + 1
    assert all(size[r["shard_id"]] == r["shard_bytes"] and rows[r["shard_id"]] == r["shard_rows"] for r in got)
    assert all(r["shard_bytes"] <= 700 or r["oversized"] and r["shard_rows"] == 1 for r in got)
    assert len({r["shard_id"] for r in got if r["doc_id"] == 60}) == 3  # copies that together exceed the limit
    assert sharding.assign(odd.limit(0)).count() == 0


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd, path, 5000)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert len(os.listdir(path)) > 3


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("a<!-- x --> b", "a b"), ("<p>a<p>b <b>c</b>\n d", "a\n\nb c d"),
    ("<title>t</title><style>p{}</style><script>var a='</p>';</script>x", "x"), ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>", "yes"),
    ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "- one\n- two\n  - in\n- three"), ("<ol start=3><li>x<li value=9>y</ol>", "3. x\n9. y"), ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name       Qty\nApple pie  3"),
    ("<table><tr><td rowspan=2>R<td>1<tr><td>2</table>", "R  1\n   2"), ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("x<br>y", "x\ny"), ("<p>x<br></p><p>y</p>", "x\n\ny"), ("<pre>\n a\n   b\n</pre>", " a\n   b"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"), ("&lt;z&amp;&eacute;", "<z&é"),
    ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("<p", ""), ("a < b", "a < b"), ("<td>loose", "loose"), ("</p>x", "x"), ("<textarea>\n<b></textarea>", "<b>"), ("<select><option>a<option>b</select>", "a\nb")])
def test_visible_text(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<tr>x", "x"), ("<tbody>x", "x"), ("<thead>x", "x"), ("<caption>x", "x"), ("<table></table><tr>x", "x"), ("</table><tr>x", "x"), ("<table><tr><td>a</table><tr>b<td>c", "a\n\nbc")])
def test_table_parts_without_a_table(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("<table><form><tr><td>x</table>", "x"), ("<table><tr><form><td>x</table>", "x"), ("<table><p>x</p><tr><td>y</table>", "x\n\ny"), ("<table><tr><div>x</div></tr></table>", "x"), ("<table><a href=u>x</a></table>", "x"),
    ("<table><div>a<tr><td>b<td>c</div>d</table>e", "a\n\nb  cd\n\ne"), ("<table><tr><td>a<tr><b>x</b><td>b</table>", "x\n\na\nb"), ("<table><tbody><p>x<tr><td>y", "x\n\ny"), ("<table><colgroup><p>x</p><tr><td>y", "x\n\ny"), ("<table><colgroup>x<tr><td>y", "x\n\ny"),
    ("<table><caption>c<tr><td>y", "c\ny"), ("<table><caption>c<td>y", "c\ny"), ("<table><tr><table><tr><td>y", "y"), ("<table><tr><td>a<table><tr><td>b</table></table>", "a\n\nb"), ("<table><tr><script>no</script><style>no</style><td>y", "y"), ("<table><textarea>x</textarea><tr><td>y", "x\n\ny"),
    ("<table><template><tr><p>no</template><tr><td>y", "y"), ("<table style='display:none'><tr><td>no</table>y", "y"), ("<table><tr><select><option>x</select><td>y", "x\n\ny")])
def test_text_in_tables_outside_of_cells(page, want):
    assert visible_text(page) == want


@pytest.mark.parametrize("style, seen", [
    ("display:none", False), ("display:none;display:block", True), ("display:block;display:none", False), ("display:none!important;display:block", False), ("display : NONE ! important ;display:block!important", True),
    ("display:none;display:nonsense", False), ("/* display:none */color:red", True), ("x-display:none", True), ("display:none/*", False), ("background:url(a:b);display:none", False), ("display:inline-block", True),
    ("visibility:hidden;visibility:visible", True), ("visibility:visible;visibility:hidden", False), ("visibility:hidden!important;visibility:visible", False), ("visibility:collapse", False), ("visibility:gone", True)])
def test_the_last_declaration_counts(style, seen):
    assert visible_text(f'<p>a</p><p style="{style}">b</p>') == ("a\n\nb" if seen else "a")


def test_declarations_and_attributes():
    assert visible_text("<p hidden>no<p hidden style='display:block'>yes<p hidden style='color:red'>no") == "yes"
    assert visible_text("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b><i style='visibility:inherit'>no</i></div>") == "yes"
    assert visible_text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"


def test_the_foot_of_a_table_stands_below():
    assert visible_text("<table><tfoot><tr><td>sum</tfoot><thead><tr><td>head</thead><tbody><tr><td>row</tbody></table>") == "head\nrow\nsum"
    assert visible_text("<table><tfoot><tr><td>1</tfoot><tfoot><tr><td>2</tfoot><tr><td>3</table>") == "2\n3\n1"


@pytest.mark.parametrize("depth", [119, 130, 20000])
def test_depth_changes_nothing(depth):
    top = "<font>" * depth
    for hidden in ("<script>no</script>", "<style>no</style>", "<div style='display:none'><b>no</b></div>", "<p hidden>no</p>"):
        assert visible_text(f"{top}a{hidden}") == "a"
    assert visible_text(f"{top}<ul><li>one<li>two<ul><li>in</ul></ul>") == "- one\n- two\n  - in"
    assert visible_text(f"{top}<table><tr><td>a b<td>c<tr><td>d<td>e</table>") == "a b  c\nd    e"


@pytest.mark.parametrize("open_", ["<ul><li>", "<ol><li>", "<table><tr><td>", "<blockquote>", "<dl><dd>", "<pre>"])
def test_text_of_deep_blocks_stays(open_):
    got = visible_text("".join(f"{open_}w{k} <script>no</script>" for k in range(3000)))
    assert [w for w in got.split() if w.startswith("w")] == [f"w{k}" for k in range(3000)] and "no" not in got


def test_hostile_pages_end():
    assert visible_text("<div>" * 50000 + "deep").endswith("deep")
    assert visible_text("<a href='" * 2000).count("<") <= 2000 and visible_text("<b>x" * 20000).startswith("xx")
    assert len(visible_text("<p>word word</p>" * 50000).split()) == 100000


def test_pages(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (2, None), (3, ""), (None, "b<br>c")]
    frame = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id bigint, html string, text string, n_lines int")
    assert sorted(map(str, html_text.extract(frame).collect())) == sorted(f"Row(page_id={i}, text={t!r}, n_lines={n})" for i, t, n in ((1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0), (None, "b\nc", 2)))
    assert html_text.extract(frame.limit(0)).count() == 0
    assert QUERIES["op4_html_text"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near duplicates", "benchmark", "bpe"]
    full = {r["doc_id"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in QUERIES["op2_toxicity"](spark, SF).collect() if r["predicted"]}
    alike = {r["doc_id"]: r["component_id"] for r in QUERIES["op8_simhash_near_dedup"](spark, SF).collect()}
    leaks = {r["doc_id"] for r in QUERIES["op10_decontamination"](spark, SF).collect()}
    lost = {r["doc_id"] for r in QUERIES["op9_language_id"](spark, SF).collect() if r["lang_pred"] == "und" or r["score"] < corpus_pipeline.LANGUAGE_SCORE}
    wanted = [full - toxic, full - lost, {i for i, c in alike.items() if i == c}, full - leaks]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want, name


def test_run_and_odd_documents(spark, odd):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < 200
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert kept.where("doc_id = 60").count() <= 1


def test_near_duplicates_are_dropped_by_row(spark):
    text = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (1, text["c"]), (1, text["d"]), (2, text["d"]), (None, text["d"]), (3, text["e"]), (3, text["e"]), (5, text["f"]), (4, text["f"]), (5, text["c"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, text["a"]), (None, text["b"]), (1, text["c"]), (1, text["d"]), (3, text["e"]), (4, text["f"])], key=str)
