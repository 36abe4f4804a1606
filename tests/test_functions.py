import random
import re
from datetime import datetime, timezone
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions import identity, markup, terms, text, times, urls
from joblode.functions import variants as V


def values(spark, expression, inputs, kind="string"):
    """Apply an expression to column x over a list of inputs, in input order."""
    frame = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [row.y for row in frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_matches_python_split(spark):
    samples = [
        None, "", "   ", "a", " a  b ", "a\tb\nc", "a\u00a0b", "\u2003x\u3000", "\x1ca\x1fb", "ş  ğ", "a\u200bb",
        "a b", "x\r\n\r\ny", "tab\t", "ü\x85ü",
    ]
    expected = [None if s is None else " ".join(s.split()) or None for s in samples]
    assert values(spark, text.clean, samples) == expected


def test_clean_on_random_text(spark):
    seen = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(alphabet=st.sampled_from("ab \t\n\x0b\x1d\x85\xa0\u2009\u3000üş-"), max_size=12))
    def gather(sample):
        seen.append(sample)

    gather()
    assert values(spark, text.clean, seen) == [" ".join(s.split()) or None for s in seen]


def test_language_and_snippet(spark):
    assert values(spark, text.language, ["Yazılım", "Developer", None, "Müller"]) == ["tr", "en", "en", "tr"]
    long = "w" * 276 + " " + "x" * 40
    cut = values(spark, text.snippet, ["a" * 280, "a" * 281, "ü" * 300, long])
    assert cut == ["a" * 280, "a" * 277 + "...", "ü" * 277 + "...", "w" * 276 + "..."]


TITLES = {
    "junior SRE for ML {worldwide, temp} / nights": "SRE for ML Nights",
    "sr. eng": ". Eng",
    "Sr.Remote Engineer": ". Engineer",
    "Jr.Contract Developer": ". Developer",
    "Tram Driver | Full time": "Tram Driver",
    "Lead - Data / ML Engineer": "Data ML Engineer",
    "Remote": "Remote",
    "HEAD OF QA": "Head of QA",
    "mid-level ios developer": "iOS Developer",
    "a - | - b": "A - B",
    "Full_time Engineer": "Full_time Engineer",
    "Staff Yazılım Geliştirici [Hybrid]": "Yazılım Geliştirici",
    "Internship: data, sql; (paris)": "Data SQL Paris",
    "C++ dev": "C++ Dev",
    "K8s admin": "K8s Admin",
}


def test_title_normalization(spark):
    def normal(x):
        core = text.title_core(text.clean(x))
        return F.coalesce(text.blank_to_null(text.title_case(core)), text.clean(x))

    assert dict(zip(TITLES, values(spark, normal, list(TITLES)))) == TITLES


def test_locations(spark):
    samples = ["Berlin, Germany", "Remote", "Paris", " , ", "a,b,c", "Anywhere in EU", None]
    pair = lambda x: F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in text.city_and_country(text.clean(x))))
    assert values(spark, pair, samples) == ["Berlin|Germany", "-|-", "Paris|-", "-|-", "a|c", "-|-", "-|-"]


def _python_contains(haystack, keyword):
    pattern = re.escape(keyword)
    pattern = (r"\b" if keyword[0].isalnum() else "") + pattern + (r"\b" if keyword[-1].isalnum() else "")
    return re.search(pattern, haystack, re.IGNORECASE) is not None


def test_text_skills_match_a_keyword_by_keyword_scan(spark):
    samples = [
        "work with ts, node.js, postgres, and k8s", "machine  learning", "machine learning, google cloud",
        "şgo go", "gıt and lınux", "beautiful soup4", "vue.js2 vue.js", "data engineering_x", "restful sqlite3 sqlite",
        "python_3 python-3", "bs4/py", "", "C++ golang!",
    ]
    spellings = terms.skill_lexicon(lexicon.SKILLS, lexicon.SKILL_ALIASES)
    expected = [
        sorted(name for name, words in spellings.items() if any(_python_contains(s, w) for w in words)) for s in samples
    ]

    def found(x):
        folded = terms.fold(x)
        hits = terms.vocabulary_hits(folded, terms.single_words(spellings))
        return F.array_sort(F.array_distinct(terms.text_skills(folded, hits)))

    assert values(spark, found, samples) == expected


def _python_label(haystack, table):
    for label, entries in table.items():
        if any(re.search(rf"\b(?:{entry})\b", haystack, re.IGNORECASE) for entry in entries):
            return label
    return None


@pytest.mark.parametrize("table", [lexicon.REMOTE_TYPES, lexicon.EMPLOYMENT_TYPES, lexicon.SENIORITY_LEVELS])
def test_labels_match_a_pattern_scan(spark, table):
    samples = [
        "remote-first", "remote first hybrid", "on site", "on  site", "in-office remote", "work from home", "full_time",
        "full\ttime", "part-time contract", "interns", "internship temp", "fixed term", "vp of sales", "vice president",
        "sr.eng", "sr", "mid level", "midlevel", "entry-level", "head of staff", "çentry level", "", "ış on-site",
    ]

    def label(x):
        folded = terms.fold(x)
        return terms.first_label(folded, terms.vocabulary_hits(folded, terms.single_words(table)), table)

    assert values(spark, label, samples) == [_python_label(s.lower(), table) for s in samples]


def test_tag_skills(spark):
    tags = ["Python", "K8s", "remote", " Node.js ", "golang", "Tableau", "", "Google  Cloud", "full-time"]
    frame = spark.createDataFrame([(tags,)], "t array<string>")
    got = frame.select(terms.tag_skills(F.col("t")).alias("s")).first().s
    assert got == ["python", "kubernetes", "node", "go", "tableau", "gcp"]


URLS = {
    "https://Example.com/Jobs/1/#apply": "https://example.com/Jobs/1",
    "https://example.com/jobs/1?x=1/#f": "https://example.com/jobs/1?x=1/",
    "HTTP://h/a//": "http://h/a",
    "https://h/": "https://h",
    "example.com/Jobs/": "example.com/jobs",
    "  https://h/a b/  ": "https://h/a b",
    "https://h/a?": "https://h/a",
    "///": None,
    "": None,
    "mailto:x@Y.z": "mailto:x@y.z",
    None: None,
}


def test_canonical_url(spark):
    assert dict(zip(URLS, values(spark, urls.canonical_url, list(URLS)))) == URLS


def test_valid_url_agrees_with_the_validation_library(spark):
    pydantic = pytest.importorskip("pydantic")
    adapter = pydantic.TypeAdapter(pydantic.HttpUrl)
    samples = [
        "https://example.com/jobs/1", "HTTPS://Example.com:443/a/../b/./c", "http://h:80", "http://h:8080/x?q=a b",
        "not-a-url", "ftp://x/y", "https://", "https://user:pw@h.com/p", "https://h/p%20q/ü?x='1'#<f>", "http:/foo/bar",
        "https:example.com", "https://h/a\\b", "https://1.2.3.4/x", "https://[::1]:80/x", "https://h:99999/", "https://h:/x",
        "https://a b.com/", "https://h.com/" + "x" * 2100, "https://h?x=1", "https://h#f", "https://h/{a}|b", "https://h/..",
        "https://M\u00fcnchen.de/a", "http://b\u00fccher.example:80/\u00fc", "https://\u4e2d\u56fd.\u4e2d\u56fd/", "https://stra\u00dfe.de/x", "https://u@\u0131\u015f\u0131k.com.tr",
        "https://\u043f\u0440\u0438\u0432\u0435\u0442.\u0440\u0444:8443/?q", "https://\uff4a\uff4f\uff42\uff53\u3002example/", "https://a\u00adb.com/", "https://\u015eEH\u0130R.example/",
        "javascript:alert(1)", "https://h_x.com/", "https://H.COM./p", "https://example.com/a.html?b=c.d#e", "https://h/%2e%2e/x",
    ]
    expected = []
    for sample in samples:
        try:
            expected.append(str(adapter.validate_python(sample)))
        except pydantic.ValidationError:
            expected.append(None)
    got = values(spark, urls.valid_http_url, samples)
    assert {s: g for s, g in zip(samples, got)} == {s: e for s, e in zip(samples, expected)}


def test_punycode_agrees_with_the_codec(spark):
    rng = random.Random(5)
    alphabet = "abcxyz019-\u00e4\u00fc\u00df\u0131\u015f\u011f\u4e2d\u56fd\u65e5\u672c\u043f\u0440\u0438\u0432\u0435\u0442\u05d0\u3042\U0001f600\U0010ffff"
    labels = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]
    labels += ["\u00fc", "\u00fc" * 250, "a" * 200 + "\U0010ffff", "\U0010ffff" * 3 + "\u0080", "\u4e2d" + "-" * 9]
    labels = [label for label in labels if not label.isascii()]
    assert values(spark, urls.punycode, labels) == [label.encode("punycode").decode() for label in labels]


def _python_posted(raw):
    cleaned = " ".join(raw.split())
    if not cleaned:
        return None
    if cleaned.isdigit():
        value = int(cleaned) // (1000 if len(cleaned) > 10 else 1)
        return datetime.fromtimestamp(value, tz=timezone.utc)
    try:
        parsed = datetime.fromisoformat(cleaned.replace("Z", "+00:00"))
    except ValueError:
        return None
    return parsed.replace(tzinfo=timezone.utc) if parsed.tzinfo is None else parsed.astimezone(timezone.utc)


def test_posted_at_agrees_with_python(spark):
    samples = [
        "2026-03-20T10:00:00+00:00", "2026-03-20", "2026-03-20 10:00", "2026-03-20T10", "20260320T101010", "2026-W12-5",
        "2026W125", "2026-W12", "2026-W54-1", "2026-03", "2026-3-5", "10:30", "not-a-date", "1774000000", "1774000000123",
        "20260320", "2026-03-20T10:00:00.123456789Z", "2026-03-20T10:00:00,5-0330", "2026-03-20T25:00", "2026-02-30",
        "2026-03-20T10:00:00+23:59", "2026-03-20T10:00:00-05", "2026-03-20x10:00", " 2026-03-20T10:00:00Z ", "",
        "2026-03-20T10:00:00Z", "0001-01-02T00:00:00+01:00", "2026-03-20T1000", "2026-03-20T10:00:00.", "0000-01-01",
    ]
    got = values(spark, lambda x: F.unix_micros(times.posted_at(x)), samples)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    micro = lambda d: None if d is None else (d - epoch).days * 86400 * 10**6 + (d - epoch).seconds * 10**6 + (d - epoch).microseconds
    expected = [micro(_python_posted(s)) for s in samples]
    assert dict(zip(samples, got)) == dict(zip(samples, expected))


def test_epoch_past_the_last_year_is_rejected(spark):
    samples = ["253402300799999", "253402300800000", "9" * 30, "1774000000", "x", None]
    assert values(spark, times.epoch_out_of_range, samples) == [False, True, True, False, False, False]


def test_freshness_never_negative(spark):
    as_of = datetime(2026, 3, 22, 12, tzinfo=timezone.utc)
    days = lambda x: times.freshness_days(times.posted_at(x), as_of)
    assert values(spark, days, ["2026-03-20T23:59:59Z", "2026-04-01", "bad"]) == [2, 0, None]


def test_identity_hashes(spark):
    import hashlib

    frame = spark.createDataFrame([("s", "1", None)], "a string, b string, u string")
    got = frame.select(identity.job_id(F.col("a"), F.col("b"), F.col("u")).alias("i"),
                       identity.fallback_source_job_id(F.col("u"), F.col("a"), F.lit("")).alias("f"),
                       identity.fallback_source_job_id(F.col("u")).alias("m")).first()
    digest = lambda s, n: hashlib.sha256(s.encode()).hexdigest()[:n]
    assert (got.i, got.f, got.m) == (digest("s:1:", 24), digest("s", 16), digest("missing-source-id", 16))


def test_html_text(spark):
    samples = [
        "<p>a<b>b</b>c</p>", "plain  text", "x &amp; y &lt;z&gt; &copy;&nbsp;q", "<script>var a='<p>';</script>t<!-- c -->u",
        "<style>p{}</style>", "a<br/>b", "&unknown; &#65;&#x42; &#150;", "unclosed <b>bold <i>it", "AT&T x", None, "",
    ]
    expected = [
        "a b c", "plain text", "x & y <z> © q", "t u", None, "a b", "&unknown AB –", "unclosed bold it", "AT&T x", None, None,
    ]
    assert values(spark, markup.html_text, samples) == expected
    odd = ["<a href='x>y' b=\"'\">t</a>", "<![CDATA[ cd <i> &amp; ]]>&hellip;", "q&#x1F600;&#128;&#xD800;&#99999999999;", "<script>never closed <b>x", "x &amp",
           "a < b <3 </ c>d", "<template>u</template>&NotEqualTilde;v", "<p>" + "w " * 50000 + "<b>" * 50000 + "&amp;" * 5000]
    assert values(spark, markup.html_text, odd) == [
        "t", "cd <i> &amp; …", "q😀€��", None, "x &amp", "a < b <3 d", "\u2242\u0338v", ("w " * 50000 + "&" * 5000).strip()
    ]


def test_html_text_like_the_element_tree(spark):
    draw = random.Random(3)
    atoms = ["<p>", "</p>", "a", "b c", "<br/>", "&amp;", "&amp ", "&copy;", "&#65;", "&#x42;", "&#150;", "<!-- x > y -->", "<script>var t='</p>';</script>",
             "<STYLE>q</StYle >", " ", "\n", "<a href='x>y'>", "</a>", "a < b", "<3", "& ", "&unknown;", "&nbsp;", "&lt;b&gt;", "é", "😀", "<!DOCTYPE html>", "<?pi x?>",
             "<rt>r</rt>", "<template>t<b>u</b></template>", "<b class=x>", "&hellip;"]
    samples = ["".join(draw.choices(atoms, k=draw.randint(1, 9))) for _ in range(800)]
    assert values(spark, markup.html_text, samples) == [markup.tree(" ".join(x.split())).text() for x in samples]


def test_html_text_stays_in_the_jvm(spark):
    frame = spark.createDataFrame([("<p>x",)], "x string").select(markup.html_text(F.col("x")))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_variant_readers(spark):
    rows = [
        ('{"n": 50000.7, "t": "a, b,,a", "b": true, "l": [{"name": "X"}, {"short_name": "Y"}, "X", 5]}',),
        ('{"n": "60000", "t": ["p", " q ", "p", null], "b": "No", "l": "none"}',),
        ('{"n": "50,000", "b": 1, "x": {"y": {"z": " deep "}}, "l": []}',),
        ('{"n": "50_000", "x": "flat"}',),
    ]
    doc = F.try_parse_json("j")
    got = spark.createDataFrame(rows, "j string").select(
        V.whole_number_at(doc, "$.n").alias("n"), V.tags_at(doc, "$.t").alias("t"), V.truth_at(doc, "$.b").alias("b"),
        V.location_names_at(doc, "$.l").alias("l"), V.text_at(doc, "$.x.y.z").alias("z"),
    ).collect()
    assert [tuple(row) for row in got] == [
        (50000, ["a", "b"], True, "X, Y, 5", None),
        (60000, ["p", "q"], False, None, None),
        (None, [], True, None, "deep"),
        (50000, [], None, None, None),
    ]


def test_salary_text(spark):
    rows = [(50000, 60000), (50000, None), (0, 70000), (None, None), (0, 0), (1234567, 0)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select(V.salary_text(F.col("a"), F.col("b")).alias("s")).collect()
    assert [row.s for row in got] == ["$50,000 - $60,000", "$50,000+", "Up to $70,000", None, None, "$1,234,567+"]


def test_addresses_in_capitals(spark):
    """Only scheme and host are lowered; what needs more than that still goes the long way."""
    samples = ["HTTPS://Jobs.Example.com/P/1/#Apply", "Http://A.b/x", "https://EX.com/a\n", "HTTP://Ex.com:80/", "HTTPS://Ex.com/a/../B", "HTTPS://U@Ex.com/", "FTP://Ex.com/"]
    assert values(spark, urls.valid_http_url, samples) == [
        "https://jobs.example.com/P/1/#Apply", "http://a.b/x", "https://ex.com/a", "http://ex.com/", "https://ex.com/B", "https://U@ex.com/", None
    ]


def test_digits_behind_the_last_one_are_not_computed(spark):
    """Long differences leave the nested digits; the loop behind them is short."""
    labels = ["ü", "bücher", "東京", "a" * 1200 + "\U0010ffff", "\U0010ffff" * 3 + "\u0080" + "z" * 600 + "\U0010ffff", "пример-日本"]
    assert values(spark, urls.punycode, labels) == [label.encode("punycode").decode() for label in labels]
    text = str(urls.punycode(F.col("label")))
    assert f"sequence({urls._NESTED_DIGITS + 1}," in text and "sequence(1, 12)" not in text


def _shown(element):
    return element.tag, element.attrs, [child if isinstance(child, str) else _shown(child) for child in element.children]


def test_plain_documents_are_read_without_the_parser_and_alike():
    plain = ['<div class="a job a">', "</div>", "<p>", "</p>", "<br>", '<a href="/x">', "</a>", "</b>", "text ", "\n", '<h2 itemprop="">', "</h2>"]
    odd = ["&amp;", "&", "<", ">", "<P>", "<br/>", "<p class=x>", "<!-- c -->", "<script>", "</script>", "<title>", '<p a="1"b="2">', "</p >"]
    chosen, read = random.Random(5), 0
    for i in range(3000):
        document = "".join(chosen.choices(plain + odd * (i % 2), k=chosen.randint(0, 15)))
        reader = markup._TreeReader()
        reader.feed(document)
        reader.close()
        read += markup._plain_tree(document) is not None
        assert _shown(markup.tree(document)) == _shown(reader.root), document
        for selector in ("a[href]", ".a", "div.job p", "[class*='jo']", "[itemprop]", "h2", "div .a"):
            wanted = [element.attrs for element in markup.select(reader.root, selector)]
            found = markup.tree(document).indexed()
            assert [element.attrs for element in markup.select(found, selector)] == wanted
            assert (first.attrs if (first := markup.first(found, selector)) is not None else None) == (wanted[0] if wanted else None)
    assert read >= 1500


def test_links_are_joined_without_parsing_and_alike():
    pieces, chosen = ["/", "a", "B-1", "..", ".", "?", "=", "#", ";", "https://", "h.x", "%20", "//", ":"], random.Random(5)
    for base in ("", "https://a.b/c/d?x#y", "mailto:x", "file:///a/b", "//h/x", "x"):
        for _ in range(2000):
            href = "".join(chosen.choices(pieces, k=chosen.randint(0, 6)))
            try:
                wanted = urljoin(base, href)
            except ValueError:
                continue
            assert markup.absolute(base, href) == wanted, (base, href)
