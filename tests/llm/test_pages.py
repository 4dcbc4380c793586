import random

from pyspark.sql import functions as F

from chainloom.llm import wrapper


def pages(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return table.select("*", *[F.lit("extra").alias(c) for c in ("host", "text", "part", "wrapper")])


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


FURNITURE = (
    '<header><a href="/">Home</a> Site name</header><nav><ul><li><a href="/{n}">menu {n}</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies {n}</div><div class="ad">Buy {n}</div><aside>Read also {n}</aside>'
)


def page(n, body, tail=True):
    head = f"<!DOCTYPE html><html><head><title>t{n}</title><style>p{{x:y}}</style><script>var a='</p>'+{n};</script></head><body>"
    end = '<section class="comments"><p>great {0}</p></section><form><p>Name</p><input></form><footer>&copy; {0}</footer></body></html>'
    return head + FURNITURE.replace("{n}", str(n)) + body + (end.replace("{0}", str(n)) if tail else "")


def test_articles_keep_every_block_and_nothing_else(spark):
    rows = [(i, f"https://a.example.org/{i}", page(i, f"<article><h1>Title {i}</h1><p>One&nbsp; two\n<b>three</b> &amp; {i}<br>four<p>Same line</p><!-- x --><div class='ad'>ad</div><ul><li>x<li>y</ul></article>")) for i in range(12)]
    got = texts(wrapper.main_text(pages(spark, rows)))
    assert got == {i: f"Title {i}\nOne two three & {i} four\nSame line\nx\ny" for i in range(12)}


def test_template_of_a_host_without_marks_is_found(spark):
    def bare(i):
        return f"<body><div id=top>Always here</div><div id=text><p>Text {i} begins.</p><p>More {i * 7}.</p></div><div id=end>All rights</div></body>"

    rows = [(i, f"http://b.example.org/{i}", bare(i)) for i in range(8)] + [(100, "http://alone.example.org/", bare(100))]
    got = texts(wrapper.main_text(pages(spark, rows).repartition(3)))
    assert all(got[i] == f"Text {i} begins.\nMore {i * 7}." for i in range(8))
    assert got[100] == "Always here\nText 100 begins.\nMore 700.\nAll rights"  # nothing to compare with


def test_ids_of_single_pages_stay_out_of_the_wrapper(spark):
    def slug(i):
        return "".join("abcdefghij"[int(c)] for c in f"{i:04}")

    def long(i):
        parts = "".join(f'<h2 id="{slug(i)}-{slug(k)}">Head {i} {k}</h2><p class="{slug(i * 7 + k)}">Part {k} of {i}.</p>' for k in range(5))
        return f"<body><div id=top>Always here</div><div id=text>{parts}<p>End of {i}</p></div><div id=end>All rights</div></body>"

    rows = [(i, f"http://s.example.org/{i}", long(i)) for i in range(60)]
    table = pages(spark, rows).repartition(3)
    got = texts(wrapper.main_text(table))
    for i in range(60):
        assert got[i].split("\n") == [*[x for k in range(5) for x in (f"Head {i} {k}", f"Part {k} of {i}.")], f"End of {i}"]
    kept = wrapper.wrappers(table.select(F.lit("s").alias("host"), "html")).collect()
    assert len(kept) == 1 and kept[0].wrapper.count("[") <= 2 * 6  # a node has two brackets: html, body, three divs, one p


def test_copies_of_one_page_are_not_taken_for_template(spark):
    rows = [(i, "http://c.example.org/x", "<body><div><p>The same text.</p></div></body>") for i in range(5)]
    assert set(texts(wrapper.main_text(pages(spark, rows))).values()) == {"The same text."}


def test_awkward_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [
        (1, None, "<p>No url</p>"), (2, "http://d.example.org", None), (3, "http://d.example.org", ""), (4, "not a url", "plain &lt;text&gt; &am"),
        (None, "http://d.example.org", "<article><p>no id"), (6, "http://e.example.org", deep), (7, "http://f.example.org", "<article><p>x" + " y" * 100_000),
        (7, "http://f.example.org", "<article><p>x" + " y" * 100_000), (8, "http://g.example.org", "<article><p title='a > b'>q</p><p>r < s</p></article"),
        (9, "http://h.example.org", "<script>never closed <p>text"), (10, "HTTP://U@I.example.org:80/p", "<main>m<table><tr><td>a<td>b<tr><td>c</table></main>"),
    ]
    got = wrapper.main_text(pages(spark, rows)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 11 and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == "No url" and by[2] == by[3] == by[9] == "" and by[4] == "plain <text> &am" and by[None] == "no id"
    assert by[6] == "deep" and by[7] == "x" + " y" * 100_000 and by[8] == "q\nr < s" and by[10] == "m\na\nb\nc"
    assert wrapper.main_text(pages(spark, rows).limit(0)).count() == 0


def test_tree_matching_against_the_recursive_definition():
    rng = random.Random(3)

    def tree(depth):
        keys = rng.sample("abcde", rng.randrange(0, 4)) if depth else []
        return wrapper.Node("r", str(rng.randrange(2)), 1, [(lambda n, k: wrapper.Node(k, n.same, 1, n.kids))(tree(depth - 1), k) for k in keys])

    def definition(a, b):
        if a.key != b.key:
            return 0

        def rows(x, y):
            if not x or not y:
                return 0
            return max(rows(x[1:], y), rows(x, y[1:]), rows(x[1:], y[1:]) + definition(x[0], y[0]))

        return 1 + rows(a.kids, b.kids)

    for _ in range(150):
        a, b = tree(3), tree(3)
        assert wrapper.size(a, b) == definition(a, b)
        whole = wrapper.merge(a, b)
        assert whole.pages == 2 and wrapper.from_plain(whole.plain()).plain() == whole.plain()
