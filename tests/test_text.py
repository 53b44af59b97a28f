import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolesift.functions import profile_text, pyformat, quality, roles, spans, text


def test_strip_html(evaluate):
    got = evaluate(text.strip_html, [
        "<p>One</p><p>Two</p>", "a<br/>b<br>c", "<ul><li class='x'>k</li></ul>", "  x \t\t y ", None, "&lt;b&gt;",
        "<link rel=a>z", "<BR>q", "a\n\n\n\nb"])
    assert got == ["One\nTwo", "a\nb\nc", "k", "x y", "", "&lt;b&gt;", "z", "q", "a\nb"]


def test_parse_experience(evaluate):
    got = evaluate(text.parse_experience, [
        "3 - 5 years", "2+ Years of work", "minimum 4 years", "1.5-2.5 year", "3–5 years", None,
        "5+ years, or 1-2 years", "3 - 4 years"])
    assert [(r["min"], r["max"]) for r in got] == [
        (3, 5), (2, None), (4, None), (1.5, 2.5), (None, None), (None, None), (1, 2), (3, 4)]


def test_parse_salary(evaluate):
    got = evaluate(text.parse_salary, [
        "$211.4K - $290.6K", "$100,000 – 120,000", "$1 - 2m", "$. - $5", "none", None])
    assert [(r["min"], r["max"], r["currency"]) for r in got] == [
        (211400.0, 290600.0, "USD"), (100000.0, 120000.0, "USD"), (1.0, 2000000.0, "USD"),
        (None, None, None), (None, None, None), (None, None, None)]


def test_work_mode(evaluate):
    got = evaluate(text.work_mode, ["Hybrid remote", "Remote", "remotely", "On-site", "based in Pune", "", None])
    assert got == ["hybrid", "remote", None, "onsite", "onsite", None, None]


def test_make_id(spark):
    df = spark.createDataFrame([("Acme Inc.", "", "Ü", None)], "a string, b string, c string, d string")
    assert df.select(text.make_id("a", "b", "c", "d")).first()[0] == "acme-inc-"
    long = spark.createDataFrame([("x" * 200,)], "a string").select(text.make_id("a")).first()[0]
    assert len(long) == 200


def test_canonical_url(evaluate):
    got = evaluate(text.canonical_url, [
        "https://Jobs.Example.com/A/b/?x=1#f", "http://h", "//h/p//", "example.com/x", "mailto:a@b", "", None,
        " https://h/p\n", "http://[::1/x"])
    assert got == ["jobs.example.com/A/b", "h", "h/p", None, None, None, None, "h/p", None]


def test_titles_match(spark):
    rows = [("Product Manager", "product manager", True), ("APM", "apm intern", True), ("", "x", False), (None, "x", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(text.titles_match("a", "b") != F.col("want")).count() == 0


def test_significant_words_and_coverage(evaluate):
    assert evaluate(text.significant_words, ["This will Write SQL and write reports"]) == [["write", "write", "reports"]]
    got = evaluate(lambda c: text.phrase_coverage(c, F.lit("wrote reports on sql")), ["SQL", "write reports", "nothing here"])
    assert got == [1.0, 0.5, 0.0]


def test_title_relevance(evaluate):
    phrases = text.phrase_token_sets(text.text_array(["Product Manager", "  ", "Business Analyst"]))
    got = evaluate(lambda c: text.title_is_relevant(c, phrases), [
        "Manager, Product", "Business Analysis Lead", "Accounts Manager", "", None])
    assert got == [True, True, False, False, False]


def test_location_relevance(evaluate):
    got = evaluate(lambda c: text.location_is_relevant(c, text.text_array(["Pune"])), [
        "PUNE, India", "Remote - US", "WFH", "Berlin", " ", None])
    assert got == [True, True, True, False, True, True]
    assert evaluate(lambda c: text.location_is_relevant(c, text.text_array([])), ["Berlin"]) == [True]


def test_expand_target_titles(spark):
    df = spark.createDataFrame([(["Associate Product Manager"], ["product analyst"]), (["Chef"], None)],
                               "t array<string>, s array<string>")
    first, second = [r[0] for r in df.select(text.expand_target_titles("t", "s")).collect()]
    assert first[:2] == ["Associate Product Manager", "product analyst"]
    assert "APM" in first and "Product Analyst" not in first and "PMO Analyst" not in first
    assert "Business Analyst" in first
    assert second == ["Chef"]


def test_dates(evaluate):
    assert evaluate(text.iso_date10, ["2026-01-02T10:00:00Z", "", None, "soon"]) == [dt.date(2026, 1, 2), None, None, None]
    assert evaluate(text.epoch_millis_to_date, [1767312000000.0, None], "double") == [dt.date(2026, 1, 2), None]


def test_bullets_and_fields(evaluate):
    assert evaluate(text.bullets, ["- a\n• b\n\n c - ", None]) == [["a", "b", "c"], []]
    label = lambda c: text.labelled_field(c, "Must have skills")
    assert evaluate(label, ["x\nMust have skills : SQL, Excel\ny", "none", None]) == ["SQL, Excel", None, None]


@pytest.mark.parametrize("value", [0.0, 1.0, 2.5, 10.0, 0.05, 1234567.0, 123456.0, 0.00001, 3.14159265, -2.0, 1e16])
def test_general_format(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(pyformat.general("v")).first()[0] == f"{value:g}"


@pytest.mark.parametrize("value", ["a", "it's", 'say "x"', "both ' and \"", "a\\b\n\t", "nb\xa0sp", ""])
def test_quoted(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(pyformat.quoted("v")).first()[0] == repr(value)


def test_quoted_list_and_none(spark):
    df = spark.createDataFrame([(None, ["a", "b'c"])], "n string, l array<string>")
    assert df.select(pyformat.quoted("n"), pyformat.quoted_list("l")).first()[:] == ("None", repr(["a", "b'c"]))


def test_match_spans(evaluate):
    got = evaluate(lambda c: spans.match_spans(c, "[0-9]+"), ["ab12c3", "none", "12"])
    assert [[(s["start"], s["end"]) for s in r] for r in got] == [[(2, 4), (5, 6)], [], [(0, 2)]]


def test_normalize_whitespace(evaluate):
    assert evaluate(quality.normalize_whitespace, ["  a  b \n\n\n\nc\t\td  \n"]) == ["a b\n\nc d"]


def test_mask(evaluate):
    got = evaluate(quality.mask_safe_spans, ["see https://a.b/c now", "mail a@b.co, www.x", "plain"])
    assert got == ["see " + "#" * 13 + " now", "mail " + "#" * 6 + ", " + "#" * 5, "plain"]


def test_whitespace_issues(evaluate):
    got = evaluate(quality.whitespace_issues, [
        "clean text. Fine, really", "word,word", "end.Next one", "e.g.Available", "see https://a.b,c:d", "a  b",
        "x" * 22, "etc.Fo.Bar ok", "Inc.Based,here"])
    assert got[0] == [] and got[3] == [] and got[4] == []
    assert got[1] == ["Missing space after punctuation near: 'word,word'"]
    assert got[2] == ["Missing space after period near: 'end.Next one'"]
    assert got[5] == ["Repeated whitespace near: 'a  b'"]
    assert got[6] == [
        "Unusually long unbroken lowercase word (possible missing space, best-effort check): '" + "x" * 22 + "'"]
    assert got[7] == [] and got[8] == ["Missing space after punctuation near: 'Inc.Based,here'"]


def test_role_family(spark):
    rows = [
        ("Associate Product Manager", "", "PRODUCT"), ("Product Owner", "", "PRODUCT"),
        ("Product Counsel Associate Manager", "", "LEGAL"), ("Product Marketing Manager", "", "MARKETING"),
        ("Business Analyst", "works with marketing", "BUSINESS_ANALYSIS"),
        ("Systems Analyst", "", "BUSINESS_ANALYSIS"), ("Program Coordinator", "", "PROJECT_PROGRAM"),
        ("Specialist", "join our sales group", "SALES"), ("Salesforce Admin", "", "UNKNOWN"),
        ("Software Engineer", "", "OTHER_TECH"), ("HR Business Partner", None, "HR"), (None, None, "UNKNOWN"),
        ("Specialist", "x" * 300 + " sales", "SALES"),
    ]
    df = spark.createDataFrame(rows, "t string, d string, want string")
    bad = df.withColumn("got", roles.role_family("t", "d")).filter("got != want").collect()
    assert bad == []
    head = df.filter(F.length("d") > 300).select(roles.role_family("t", "d", head_chars=300)).first()[0]
    assert head == "UNKNOWN"


def test_career_level(spark):
    rows = [
        ("Chief of Staff", None, "EXECUTIVE"), ("Associate Director", None, "DIRECTOR"), ("Head of Ops", None, "DIRECTOR"),
        ("Senior Analyst", 1.0, "SENIOR"), ("Lead Analyst", None, "LEAD"), ("Product Intern", None, "INTERN"),
        ("Internal Tools Analyst", None, "UNKNOWN"), ("Graduate Trainee", None, "ENTRY_LEVEL"),
        ("Associate Product Manager", 9.0, "JUNIOR"), ("Manager - Accounts", None, "MANAGER"),
        ("Product Manager", None, "UNKNOWN"), ("Product Manager", 0.5, "ENTRY_LEVEL"),
        ("Product Manager", 2.0, "JUNIOR"), ("Product Manager", 3.0, "MID_LEVEL"),
        ("Product Manager", 7.0, "SENIOR"), ("Product Manager", 8.0, "LEAD"),
    ]
    df = spark.createDataFrame(rows, "t string, y double, want string")
    assert df.withColumn("got", roles.career_level("t", "y")).filter("got != want").collect() == []


def test_profile_text(evaluate):
    note = (
        "# Profile\n\n## Contact\n\n- Mail: x\n\n## Experience overview\n\n- Total: 1\n"
        "- Current / most recent role: Analyst, Acme LLP — Pune, India (2025)\n- Previous roles:\n"
        "  - Intern, Beta Labs - Delhi (2023)\n  - Intern, acme llp — Pune\n\n## Education\n- School, Town\n")
    assert evaluate(profile_text.verified_employers, [note, None, "x"]) == [["Acme LLP", "Beta Labs"], [], []]
    assert evaluate(lambda c: profile_text.md_section(c, "Contact"), [note, "## Contact\n## Next\nx", "none"]) == ["- Mail: x", "", ""]
    assert evaluate(lambda c: profile_text.md_section(c, "Education"), [note]) == ["- School, Town"]


def test_a_plain_search_before_the_pattern_changes_no_family_and_no_level(spark):
    from rolesift import rules
    from rolesift.operators.pair_rules import posting_features
    phrases = [p for _, listed in [*rules.FAMILY_PHRASES, *rules.LEVEL_MARKERS] for p in listed] + rules.FUNCTION_TITLE_PHRASES
    assert all(c.isalnum() or c in " -" for p in phrases for c in p)
    titles = [None, "", " ", "Product Managerial", "Manager - Accounts", "Leading hand", "Örsales", "sales lead", *[
        f"{a}{p.title()}{b}" for p in phrases for a, b in (("", ""), ("x", ""), ("\tSr. ", " (EU) "))]]
    rows = spark.createDataFrame(
        [(t, d, y) for t in titles for d, y in ((None, None), ("", 3.0), ("We seek a DevOps or Sales person.", 1.0))],
        "title string, description string, min_experience_years double")
    for name in ("location", "work_mode", "industry", "company_size", "application_url", "id"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    for name in ("required_skills", "preferred_skills"):
        rows = rows.withColumn(name, F.lit(None).cast("array<string>"))
    for name in ("salary_min", "salary_max", "max_experience_years"):
        rows = rows.withColumn(name, F.lit(None).cast("double"))
    features = posting_features(rows, "description")
    plan = features.select("role_family", "title_family")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(coalesce(title#") == 1, plan
    want = rows.select("title", "description", "min_experience_years", roles.role_family("title", "description"),
                       roles.title_family("title"), roles.career_level("title", "min_experience_years"))
    got = features.select("title", "description", "min_experience_years", "role_family", "title_family", "career_level")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
