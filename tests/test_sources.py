import json

from postmill.sources import ats, feeds, html


def landed(spark, *payloads, slug="acme", host="jobs.acme.com", source="x"):
    return spark.createDataFrame([(source, p if isinstance(p, str) or p is None else json.dumps(p), host, slug) for p in payloads], "source string, payload string, host string, slug string")


def test_bad_payloads_give_no_rows(spark):
    df = landed(spark, '{"jobs": [{"title": ', "[1, 2", "nonsense", "", None, "{}", "[]", "<rss><item>")
    for fn in (feeds.cards_remoteok, feeds.cards_remotive, feeds.cards_workingnomads, feeds.cards_arbeitnow, feeds.cards_himalayas, feeds.cards_workable, feeds.cards_themuse, feeds.cards_freehire, feeds.cards_wwr, feeds.cards_jobicy,
               ats.raw_lever, ats.raw_ashby, ats.raw_greenhouse, ats.raw_smartrecruiters, ats.raw_workday, ats.raw_teamtailor, ats.raw_personio, ats.raw_recruitee, ats.raw_workable_widget, ats.raw_breezy, ats.raw_pinpoint, ats.raw_workable_view, ats.raw_join):
        assert fn(df).collect() == [], fn.__name__


def test_remoteok_skips_the_notice(spark):
    rows = feeds.cards_remoteok(landed(spark, [{"legal": "notice"}, {"id": 7, "position": " Dev ", "company": "", "url": "/remote-jobs/7", "tags": ["a"]}])).collect()
    assert [(r.job_id, r.title, r.company, r.location, r.url, r.tags) for r in rows] == [("remoteok:7", "Dev", None, "Remote", "https://remoteok.com/remote-jobs/7", ["a"])]


def test_wwr_titles(spark):
    feed = "<rss><channel><item><title>Acme: Dev: Ops</title><link>https://w/1</link><category>x &amp; y</category></item><item><title>No colon</title></item></channel></rss>"
    rows = feeds.cards_wwr(landed(spark, feed)).orderBy("pos").collect()
    assert [(r.company, r.title, r.tags, r.job_id) for r in rows] == [("Acme", "Dev: Ops", ["x & y"], "weworkremotely:https://w/1"), ("No colon", "No colon", [], "weworkremotely:No colon")]


def test_hn(spark):
    rows = [(1, "Acme | Engineer | Berlin | Full-time | https://acme.com | Remote<p>We do things that matter to people", None, None), (2, "short", None, None), (3, "Please do not post agencies here, thanks a lot to all of you", None, None), (4, "x" * 60, True, None), (5, "Beta — Analyst — London<p>and more text about the role itself", None, None), (6, None, None, None)]
    got = feeds.cards_hn(spark.createDataFrame(rows, "id long, text string, deleted boolean, dead boolean")).orderBy("pos").collect()
    assert [(r.job_id, r.company, r.title, r.location) for r in got] == [("hn:1", "Acme", "Engineer", "Berlin, Remote"), ("hn:5", "Beta", "Analyst", "London")]
    hits = {"hits": [{"objectID": "1", "title": "Ask HN: Who is hiring? (April 2024)"}, {"objectID": "2", "title": "Ask HN: Who is hiring? (May 2024)"}]}
    assert [feeds.hn_pick_thread(landed(spark, hits), m).first().story_id for m in ("May 2024", "June 2024")] == ["2", "1"]


def test_pinpoint_and_teamtailor(spark):
    item = {"id": "4", "title": "Dev", "url": "https://acme.pinpointhq.com/en/postings/4", "description": "<p>x</p>", "benefits": "tea", "benefits_header": "Perks & more", "location": {"city": "Leeds", "name": "Leeds"}, "compensation_visible": True, "compensation_minimum": 10, "compensation_maximum": 20, "compensation_currency": "GBP", "compensation_frequency": "year"}
    (r,) = ats.raw_pinpoint(landed(spark, {"data": [item]})).collect()
    assert r.location == "Leeds" and r.salary_hits_extra == ["GBP 10-20 year"] and r.description_html == "<p>x</p>\n<h2>Perks &amp; more</h2>\ntea"
    wanted = spark.createDataFrame([(9, "https://ACME.pinpointhq.com/en/postings/4/?utm_source=x")], "seq long, url string")
    assert [x.seq for x in ats.join_by_url(ats.raw_pinpoint(landed(spark, {"data": [item]})), wanted).collect()] == [9]
    feed = {"items": [{"id": 1, "title": "A", "_jobposting": {"baseSalary": {"currency": "SEK", "value": {"minValue": 1, "maxValue": 2}}}}]}
    (r,) = ats.raw_teamtailor(landed(spark, feed)).collect()
    assert r.salary_hits_extra == ["SEK 1-2"] and r.company == "jobs"


def test_ashby_place_may_be_text(spark):
    rows = ats.raw_ashby(landed(spark, {"title": "A", "location": "Berlin"}, {"title": "A", "location": {"name": "Berlin"}})).collect()
    assert [r.location for r in rows] == ["Berlin", "Berlin"]


def test_markdown():
    assert ats.markdown_to_html("## A & b\n* x\n* **y** *z*\n\n[l](https://e.com) <i>") == '<h3>A &amp; b</h3>\n<ul>\n<li>x</li>\n<li><strong>y</strong> <em>z</em></li>\n</ul>\n<p><a href="https://e.com">l</a> &lt;i&gt;</p>'


def test_sections():
    root = html.parse("<div><h2>Role</h2><p>Do <b>this</b> now</p><p><strong>Profile</strong></p><ul><li>one<li>two</ul></div><!-- x --><p>tail<p>end")
    assert html.split_sections(root) == [("Role", "Do this now"), ("this", "Profile"), ("Profile", "one\ntwo\ntail\nend")]
    assert html.parse_description("&lt;p&gt;a&lt;/p&gt;").line() == "a" and html.parse_description("&amp;lt;p&amp;gt;a&amp;lt;/p&amp;gt;").line() == "a"
    assert html.parse("<div>" * 5000 + "deep").line() == "deep" and html.split_sections(html.parse(None)) == []


def test_references_without_semicolon(spark, tmp_path):
    """Before, a title that was cut within `&amp;` lost the rest of the reference, unlike in the query's SQL."""
    import duckdb

    import __spark_entry__

    blob = "<title>x &amp;&amp</title><style>a>b{c:'&amp;'}</style><h1>x &amp;&quot</h1><script>if (a &amp b && c &copy) {}</script><p>&copy; y &middot; &quo</p><b>&lt;z&gt; &am &</b>"
    assert html.parse(blob.replace("&quo<", "&#39; &notit; &nope; &#x41<")).line({"script", "style"}) == 'x &&amp x &&quot © y · \' &notit; &nope; A <z> &am &'
    assert html.parse("a &amp b &lt;c", page=False).line() == "a & b <c"
    rows = [(1, "u", blob.replace("<style>a>b{c:'&amp;'}</style>", "")), (2, "u", "<p>a</p>&amp"), (3, "u", "&quot")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = __spark_entry__.queries()["d1_html_text"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(__spark_entry__.oracle_sql()["d1_html_text"]).fetchall())


def test_pages(spark):
    ld = {"@type": "JobPosting", "title": "T", "hiringOrganization": {"name": "O"}, "jobLocation": [{"address": {"addressLocality": "L"}}], "description": "<p>" + "word " * 100 + "</p>", "employmentType": ["FULL_TIME", "CONTRACTOR"]}
    pages = [(1, "u", f"<title>x</title><script type='application/ld+json'>[{json.dumps(ld)}]</script>" + "body " * 100), (2, "u", "<title>only</title><p>thin</p>"), (3, "u", "<nav>menu</nav><h1>Job</h1><p>" + "text " * 100 + "</p><footer>f</footer>"), (4, "u", None)]
    got = {r.seq: r for r in html.pages_to_postings(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (got[1].title, got[1].company, got[1].location, got[1].employment_type, got[1].via, got[1].error) == ("T", "O", "L", "FULL_TIME, CONTRACTOR", "json-ld", None)
    assert got[2].error.startswith("no readable page") and got[2].title == "only" and got[4].error and "menu" not in got[3].full_text and [s.heading for s in got[3].sections] == ["Job"]


def test_discover(spark):
    df = landed(spark, [{"hostedUrl": "https://jobs.lever.co/a/1"}, {"hostedUrl": "https://jobs.lever.co/a/1"}, {}], source="lever").unionByName(landed(spark, {"data": {"positions": [{"positionUrl": "/c/1"}, {"positionUrl": "https://x/2"}]}}, source="eightfold"))
    df = df.unionByName(landed(spark, "<positions><position><id> 5 </id></position></positions>", source="personio")).unionByName(landed(spark, "broken", source="greenhouse"))
    assert {r.url for r in ats.discover_urls(df).collect()} == {"https://jobs.lever.co/a/1", "https://acme.eightfold.ai/c/1", "https://x/2", "https://acme.jobs.personio.de/job/5"}


def test_thread_is_picked_from_all_conversations(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([(c,) for c in [*range(990, 1000), 1003, 2501, 2513, 2514]], "conv_id long").where("conv_id % 12 <> 5 OR conv_id > 1000").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.story_id for r in __spark_entry__.queries()["a12_hn_pick_thread"](spark, str(tmp_path)).collect()] == ["2501"]


def test_long_pages_wait_in_tasks_of_their_own(spark):
    from postmill.operators.tables import apart
    from pyspark.sql import functions as F

    rows = [(k, None if k == 3 else f"<p>page {k}</p>" + "x" * (3 << 20 if k in (5, 17) else 10)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    got = apart(df, "html").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.page_id, r.html or "") for r in got) == sorted((k, h or "") for k, h in rows)
    assert {r.task for r in got if r.page_id in (5, 17)}.isdisjoint(r.task for r in got if r.page_id not in (5, 17))
