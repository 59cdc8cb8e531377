import pytest

from vigil.llm.html_text import extract, html_to_text

CASES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>one<p>two <b>bold</b>\n text", "one\n\ntwo bold text"),
    ("<div>a</div><div>b</div>", "a\nb"), ("a<span> b</span>c <i> d</i>", "a bc d"),
    ("<title>t</title><style>p{}</style><script>if (a < b) '</p>'</script><p>seen", "seen"),
    ("<html><head><title>x</title><body>in", "in"),
    ("<p hidden>a</p><p style='color:red; Display : none'>b</p><div style='visibility:hidden'>c</div>d", "d"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>a<li><p>b<p>c</ol>", "3. a\n4. b\n\n   c"),
    ("<table><tr><td>a<td>long cell<tr><td>wider<td>x</table>z", "a      long cell\nwider  x\n\nz"),
    ("<table><caption>cap</caption><thead><tr><th>h<th>i<tbody><tr><td colspan=2>both<tr><td>1<td>2</table>",
     "cap\nh  i\nboth\n1  2"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a x y  b"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"), ("&copy; &lt;p&gt; &nbsp;x", "© <p>  x"),
    ("<!-- no --><img alt='pic'> <input type=hidden value=q><input value=v>", "pic v"),
    ("<details><summary>s</summary>more</details>", "s"), ("</p></div>x</table>", "x"),
    ("<select><option>a<option>b</select>k", "k"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_rendering(html, text):
    assert html_to_text(html) == text


def test_deep_and_long():
    assert html_to_text("<div>" * 30_000 + "x") == "x"
    assert html_to_text("<table><tr><td>" * 3_000 + "x") == "x"
    assert html_to_text("<p>word</p>" * 20_000).count("word") == 20_000


def test_frame_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(k, "u", h, "x", "y") for k, (h, _) in enumerate(CASES)] + [(None, None, "q", "x", "y")] * 2
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted(
        [(str(k), t) for k, (_, t) in enumerate(CASES)] + [("None", "q")] * 2)
    assert extract(spark.createDataFrame([], schema)).count() == 0
