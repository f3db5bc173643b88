import random

import numpy as np
import pytest

from chartloom.llm import html_lstm as op

FRAME = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav>{}<footer>&copy; 2020 site</footer></body></html>"


def page(rng, k):
    line = lambda n: " ".join(rng.choice(["river", "stone", "went", "over", "the", "old", "hill", "a", "bright"]) for _ in range(n)) + "."
    body = f"<div class='ad'>{line(6)}</div><article><h1>{line(4)}</h1><p><b>{line(30)}<br>" + "".join(f"<p>{line(rng.randrange(1, 40))}</p>" for _ in range(6)) + "</article>"
    return FRAME.format(body)


@pytest.fixture(scope="module")
def labeller(spark):
    rng = random.Random(1)
    rows = [(k, f"u{k}", page(rng, k)) for k in range(60)]
    return op.train(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_blocks_follow_the_markup():
    texts = lambda p: [b.text for b in op.blocks_of(p)]
    assert texts("<p>a<p>b<b>c</p>d") == ["a", "bc", "d"]
    assert texts("x &amp;amp; y<!-- no <p>n</p> -->z") == ["x &amp; yz"]
    assert texts("<script>if (a</p>b) {}</script><style>p{}</style>t  \n u<br>v") == ["t u v"]
    assert texts("a < b <p title='>'>c</p><p") == ["a < b", "c"]
    assert texts("<!-- open") == texts("") == texts("<script>never ended") == []
    assert texts("<ul><li>1<li>2</ul></p></nonsense>3") == ["1", "2", "3"]
    assert op.blocks_of("<div class='side bar2' id=x><p>t")[0].path == (("div", ("side", "bar", "x")), ("p", ()))


def test_comments_end_tags_and_references():
    texts = lambda p: [b.text for b in op.blocks_of(p)]
    tags = lambda p: [[t for t, _ in b.path] for b in op.blocks_of(p)]
    assert texts("<p>before</p><!--><p>shown</p><!-- x --><p>after</p>") == ["before", "shown", "after"]
    assert texts("<!--->a<!---->b<!-- > -- x --!>c<!-- never") == ["abc"]
    assert texts("&am<b></b>p; &lt;p&gt; &am<!-- -->p; &copy 1") == ["&amp; <p> &amp; © 1"]
    inside = tags("<aside><div><table><tr><td></div>x<p>y</td></table>z</div>w")
    table = ["aside", "div", "table", "tr", "td"]
    assert inside == [table, [*table, "p"], ["aside", "div"], ["aside"]]
    assert tags("<table><tbody><tr><td><div>a<td>b<tr><th>c<tbody><tr><td>d</table>e") == [
        ["table", "tbody", "tr", "td", "div"], ["table", "tbody", "tr", "td"], ["table", "tbody", "tr", "th"], ["table", "tbody", "tr", "td"], [],
    ]
    assert tags("<table><td><table></td></tr>n</table>o</table>p") == [["table", "td", "table"], ["table", "td"], []]
    # Neither many open cells nor many stray end tags cost more than their number.
    assert len(texts("<td><div>" * 50_000 + "</tr></b>" * 50_000 + "x")) == 1


def test_gradient_is_that_of_the_loss():
    encoder, model = op.Encoded(), op.Labeller()
    pages = [encoder.of(op.blocks_of(page(random.Random(k), k))) for k in range(2)]
    labels = [np.arange(len(p[0])) % 2 * 1.0 for p in pages]

    def loss():
        p, y = np.concatenate(model.chances(pages)), np.concatenate(labels)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, slope in model.slopes(pages, labels).items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-5
        high = loss()
        model.weights[name][at] = old - 1e-5
        assert abs((high - loss()) / 2e-5 - slope[at]) < 1e-6
        model.weights[name][at] = old


def test_held_out_pages(spark, labeller):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(40):
        html = page(rng, k)
        rows.append((k, "u", html, "clash"))
        want[k] = "\n".join(b.text for b in op.blocks_of(html[html.index("<article>") : html.index("</article>")]))
    rows += [(100, None, None, ""), (101, "u", "", ""), (102, "u", "<script>x</script>", ""), (0, "u", rows[0][2], "")]
    rows.append((103, "u", FRAME.format("<article>" + "<p>long block of words here.</p>" * 20_000 + "</article>"), ""))
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), labeller).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[k].text == want[k] for k in want)
    assert [by[k].text for k in (100, 101, 102)] == ["", "", ""] and by[100].url is None
    assert by[103].text.count("\n") == 19_999 and all(r.n_chars == len(r.text) for r in got)


def test_empty_table(spark, labeller):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.extract(empty, labeller).count() == 0 and op.extract(empty, op.train(empty)).count() == 0


def test_every_word_of_a_block_is_read():
    frame = "<p>" + "start " * 16 + "{}" + " end" * 8 + "</p>"
    encoder, model = op.Encoded(), op.Labeller()
    one, other = (encoder.of(op.blocks_of(frame.format(middle))) for middle in ("river stone " * 50, "cookies advert " * 50))
    assert one[1] != other[1] and [sum(w.values()) for w in one[1]] == [124]
    assert np.abs(model.inputs([one])[0] - model.inputs([other])[0]).max() > 1e-3
    want = model.weights["word"][[encoder.place("w " + w, op.WORD_SPACE) for w in ["start"] * 16 + ["river", "stone"] * 50 + ["end"] * 8]].mean(0)
    rest = one[2] @ model.weights["stat"] + 0.5 * model.weights["path"][one[0][0]].sum(0)
    assert np.allclose(model.inputs([one])[0][0], np.tanh(rest + want))


def test_vectors_are_looked_up_in_pieces(monkeypatch):
    encoder, model = op.Encoded(), op.Labeller()
    pages = [encoder.of(op.blocks_of(page(random.Random(k), k))) for k in range(3)]
    whole = model.inputs(pages)[0]
    monkeypatch.setattr(op, "PIECE", 7)
    assert np.allclose(model.inputs(pages)[0], whole)


def test_depth_has_no_limit():
    tags = lambda b: [t for t, _ in b.path]
    after = op.blocks_of("<aside>" + "<div>" * 5 + "<div>" * 250 + "</div>" * 250 + "t")[0]
    assert tags(after) == ["aside"] + ["div"] * 5
    menu = op.blocks_of("<a name=x>" * 300 + "<nav><ul><li>m</ul></nav><div class=comments>c</div>")
    assert [tags(b)[300:] for b in menu] == [["nav", "ul", "li"], ["div"]] and menu[1].path[-1] == ("div", ("comments",))
    deep = op.blocks_of("<font>" * 50_000 + "<i><div>x</div></b>" * 50_000 + "<footer>end")
    paths, _, _ = op.Encoded().of(deep)
    assert len(deep) == 50_001 and deep[-1].inner.tag == "footer" and paths[0] == paths[-2] != paths[-1]
