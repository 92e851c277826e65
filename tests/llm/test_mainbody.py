from ladoga.llm import mainbody
from ladoga.llm.mainbody import aligned, bodies_of, body_lines, main_bodies
from ladoga.llm.markup import read


def page(i, links=False):
    word = "".join(chr(97 + (i * k) % 26) for k in range(1, 9))
    around = [["Home", "Contacts", "Library"], ["We use cookies to remember you", "Accept"]], [["Share this page"], ["© College", "info@college.example"]]
    body = [f"Title {word}", f"The {word} office opens at nine", f"— {word};"]
    wrap = (lambda s: f'<a href="#">{s}</a>') if links else (lambda s: s)
    html = "".join(f"<div class='box'>{''.join(f'<p>{x}</p>' for x in b)}</div>" for b in around[0])
    html += "<div class='main'>" + "".join(f"<p>{wrap(x)}" for x in body) + "</div>"
    html += "".join(f"<div class='box'>{''.join(f'<p>{x}' for x in b)}</div>" for b in around[1])
    lines = [x for b in around[0] for x in b] + [""] + body + [x for b in around[1] for x in b]
    return f"<html><head><title>{body[0]}</title><script>var a='<p>no</p>'</script></head><body>{html}", "\n".join(lines), body


def frame(spark, n=30):
    rows = []
    for i in range(n):
        html, text, body = page(i, links=i % 3 == 0)
        rows.append((i, 1, body[0], None if i == 4 else html, text, 0))
    rows += [rows[7], (100, 1, None, None, None, 0), (101, None, None, "<p>x", "", 0), (102, 2, None, "<div>a<div>b", "a\nb", 0)]
    return spark.createDataFrame(rows, "id long, source_id long, title string, raw_html string, clean_text string, body int")


def test_body_is_found_with_and_without_markup(spark):
    df = frame(spark)
    got = {r["page_id"]: (r["body"], r["around"]) for r in main_bodies(df).collect()}
    assert len(got) == 33
    assert all(got[i] == ([6, 7, 8], [0, 1, 2, 3, 4, 9, 10, 11]) for i in range(30))
    assert got[100] == ([], []) and got[101] == ([], [])
    assert sorted(got[102][0] + got[102][1]) == [0, 1]
    text = {r["page_id"]: r["body_text"] for r in bodies_of(df).collect()}
    assert text[5] == "\n".join(page(5)[2]) and text[100] is None or text[100] == ""


def test_copies_of_a_page_keep_their_body(spark):
    """A third of all rows are copies of one page without markup, under ids of their own."""
    df = frame(spark)
    html, text, body = page(17)
    copies = spark.createDataFrame([(500 + i, 1, body[0], None, text, 0) for i in range(16)], df.schema)
    got = {r["page_id"]: (r["body"], r["around"]) for r in main_bodies(df.unionByName(copies)).collect()}
    assert all(got[i] == ([6, 7, 8], [0, 1, 2, 3, 4, 9, 10, 11]) for i in [*range(30), *range(500, 516)])


def test_empty(spark):
    assert main_bodies(frame(spark).limit(0)).count() == 0


def test_markup():
    p = read("<title>A &amp; B</title><body><div><p>one<b> two</b><p>three</div><table><tr><td>x</td><td>y</td></tr></table>tail<!-- <p>no --><style>p{}</style>")
    assert p.title == "A & B" and [x.text for x in p.lines] == ["one two", "three", "x\ty", "tail"]
    assert read("").lines == [] and read("< & <<p>").lines[0].text


def lines_of(blocks, heading, weights, parent=(-1, 0, 0, 0, 0)):
    """body_lines() of one page given as (container, characters, link characters, tags) of each line."""
    block, chars, links, tags = (list(x) for x in zip(*blocks))
    n = len(blocks)
    return body_lines(chars, [False] * n, [False] * n, heading, block, links, tags, list(parent), ["", "/a", "/b", "/c", "/d"], weights, lambda k: False)


def test_density_decides_where_signatures_say_nothing():
    text = [(1, 20, 0, 2), (1, 300, 0, 2), (1, 250, 0, 2)]
    menu = [(3, 12, 12, 4)] * 4
    assert lines_of(text + [(2, 400, 0, 2), (2, 200, 0, 2)] + menu, 0, {}) == [True] * 5 + [False] * 4
    # without a heading too
    assert lines_of(menu + [(4, 400, 0, 2), (4, 200, 0, 2)], -1, {}) == [False] * 4 + [True] * 2


def test_text_beside_the_container_of_the_heading():
    weights = {"/a": {"headed": 1.0, "repeated": 0.0}, "/b": {"headed": 0.0, "repeated": 0.0}, "/c": {"headed": 0.0, "repeated": 0.9}}
    assert lines_of([(1, 20, 0, 2), (2, 400, 0, 2), (2, 200, 0, 2), (3, 300, 0, 2)], 0, weights) == [True] * 3 + [False]


def test_changed_densities_change_the_body(monkeypatch):
    text, menu = [(1, 300, 0, 2), (1, 250, 0, 2)], [(3, 12, 12, 4)] * 4
    assert lines_of(text + menu, -1, {}) == [True] * 2 + [False] * 4
    monkeypatch.setattr(mainbody, "density", lambda chars, links, tags, link_tags, page_links: tags / (chars + 1))
    assert lines_of(text + menu, -1, {}) == [False] * 2 + [True] * 4


def test_links_count_against_a_container():
    linked, plain = [(1, 60, 60, 4)] * 5, [(2, 60, 0, 4)] * 4
    assert lines_of(linked + plain, -1, {}) == [False] * 5 + [True] * 4


def test_lines_are_found_in_the_markup_however_far():
    lines = [f"line {i}" for i in range(60)]
    assert list(aligned(lines, ["no such line", *lines[40:]])) == [(i + 1, 40 + i) for i in range(20)]
    assert list(aligned(["x", *lines], lines)) == [(i, i + 1) for i in range(60)]
    assert list(aligned([], lines)) == [] and list(aligned(lines, [])) == []
