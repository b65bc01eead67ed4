"""License scan, quality, mixing, HTML extraction, language ID and decontamination, with odd inputs."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from glyphspark.llm import common, decontaminate, html_extract, langid, license_scan, mixing, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def table(spark, rows, columns):
    """Rows with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "x", "x") for r in rows], columns + ", words string, n_words string")


# licenses


def licenses_brute(rows, phrases, templates, threshold):
    out = {}
    for i, t in rows:
        w, places, met = words_of(t), [], {}
        for phrase, label in phrases.items():
            p = phrase.split()
            places += [(label, k) for k in range(len(w)) if w[k : k + len(p)] == p]
        blocks = [set(w[b : b + license_scan.BLOCK]) for b in range(0, len(w), license_scan.STRIDE)]
        for label, template in templates:
            s = set(words_of(template))
            best = max((len(s & b) / len(s) for b in blocks if len(s & b) >= threshold * len(s) - 1e-9), default=0) if s else 0
            if best:
                met[label] = max(best, met.get(label, 0))
        out[i] = (len(w), sorted(places), met, 1.0 if places else max(met.values(), default=0.0))
    return out


def check_licenses(got, want):
    for r in got:
        n, places, met, score = want[r["id"]]
        assert (r["n_words"], sorted(map(tuple, r["places"]))) == (n, places)
        assert {m["label"]: pytest.approx(m["score"]) for m in r["labels_met"]} == met
        assert r["score"] == pytest.approx(score)


def test_license_scan(spark):
    rng = random.Random(1)
    words = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()} | {"mit", "cc", "2", "é"})
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(300)))) for k in range(40)]
    for k, t in enumerate([*license_scan.TEMPLATES.values(), "Under the MIT-License, under the mit license", "cc/by_nc CC by NC", "apache license version 2", None, ""]):
        filler = ["é"] * rng.randrange(200)
        rows.append((100 + k, None if t is None else " ".join([*filler, t.upper(), *filler])))
    rows += [(200, "und mit der " * 20_000 + "under the mit license"), (201, "... "), (202, "This work is licensed under the GNU General Public License, version 3."), (203, "all rights are reserved")]
    rows += [rows[40], rows[41], rows[40], (None, "under the mit license")]
    want = licenses_brute(rows, license_scan.PHRASES, license_scan.TEMPLATES.items(), license_scan.THRESHOLD)
    got = license_scan.license_scan(table(spark, rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    check_licenses(got, want)
    part = {m["label"]: m["score"] for r in got if r["id"] == 202 for m in r["labels_met"]}
    assert part == {"gpl-3": pytest.approx(0.8)}
    assert license_scan.license_scan(table(spark, [], "doc_id long, text string")).count() == 0
    assert {r["score"] for r in license_scan.license_scan(table(spark, rows, "doc_id long, text string"), phrases={}, templates=license_scan.template_table(spark, {})).collect()} == {0.0}


@pytest.mark.parametrize("small", [0, 10**6])
def test_many_templates_met_in_part(spark, monkeypatch, small):
    """A table of 300 templates, several texts to a label, blocks that hold more or less of them; the index broadcast or not."""
    monkeypatch.setattr(license_scan, "SMALL_BYTES", small)
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    templates = [(f"t{k % 250}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for k in range(300)] + [("none", " - "), ("null", None)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            some = [w for w in rng.choice(templates[:300])[1].split() if rng.random() < rng.choice([0.7, 0.85, 1.0])] if k % 5 else ["x"]
            words += [*some, *(rng.choice("xyz") for _ in range(rng.randrange(100)))]
        rows.append((k, " ".join(words)))
    phrases = {"w1 w2": "pair", "x y x": "xyx"}
    want = licenses_brute(rows, phrases, [(label, t or "") for label, t in templates], 0.75)
    got = license_scan.license_scan(table(spark, rows, "doc_id long, text string"), phrases=phrases, templates=spark.createDataFrame(templates, "label string, text string"), threshold=0.75).collect()
    check_licenses(got, want)
    assert len({round(m["score"], 3) for r in got for m in r["labels_met"]}) > 5


# quality


def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(["river", "stone", "light", "paper", "green", "walk"]) + rng.choice("abcdef") for _ in range(rng.randrange(20, 80))]
        kind = rng.randrange(6)
        if kind == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "scumbag"]))
        text = " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(words).capitalize() + "."
        rows.append((k, text, f"site{k % 5}", "en"))
        labels.append((k, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return rows, labels


@pytest.fixture(scope="module")
def graded(spark):
    rows, labels = labelled(random.Random(2), 900)
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, source string, lang string, host string, score string")
    return docs, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"), labels


def test_quality_on_held_out_rows(spark, graded):
    docs, known, labels = graded
    model = quality.fit(docs, known)
    assert {b"vile", b"scumbag"} == set(model.words)
    got = {r["id"]: r for r in quality.quality(docs, model, F.col("source"), F.col("lang")).collect()}
    wrong = [k for k, q, t in labels[600:] if got[k]["kept"] != (q == 1 and t == 0)]
    assert len(wrong) <= 3
    assert all(0 <= r["score"] <= 1 and 0 < r["path_rate"] < 1 for r in got.values())


def test_quality_odd_rows(spark, graded):
    docs, known, _ = graded
    model = quality.fit(docs, known)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (2, "", "s", "en"), (None, "!!!", "s", None), (3, "Walka " * 50_000, "s", "en"), (4, "you vile thing", "s", "en")], "doc_id long, text string, source string, lang string")
    got = quality.quality(odd, model, F.col("source"), F.col("lang")).collect()
    assert len(got) == 6 and all(r["kept"] for r in got if r["id"] in (1, 2, None)) and not any(r["kept"] for r in got if r["id"] == 4)
    empty = quality.quality(odd.limit(0), model, F.col("source"), F.col("lang"))
    assert empty.count() == 0
    silent = quality.fit(docs, known.limit(0))
    assert all(r["kept"] for r in quality.quality(docs, silent, F.col("source"), F.col("lang")).collect())


def test_sparse_sites_shrink(spark):
    rows = [(k, None, "big", "a") for k in range(400)] + [(1000 + k, None, f"small{k}", "a") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["id"]: r for r in quality.quality(docs, quality.Model([]), F.col("source"), F.col("lang")).collect()}
    assert abs(got[1000]["path_rate"] - got[0]["path_rate"]) < 1e-6


def posteriors_brute(rows, site_shift):
    """rows: (id, host, path, p) -> id: (host rate, path rate, score), from the definition."""

    def prior(groups):
        n = sum(k for _, k in groups)
        mean = min(max(sum(r * k for r, k in groups) / n, 1e-4), 1 - 1e-4)
        spread = sum(r * r * k for r, k in groups) / n - mean * mean
        spread = max(spread - mean * (1 - mean) * len(groups) / n, 1e-6)
        return mean, min(max(mean * (1 - mean) / spread - 1, 2), 10_000)

    odds = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    hosts, paths = {}, {}
    for _, h, p, x in rows:
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, p), []).append(x)
    mean, strength = prior([(sum(v) / len(v), len(v)) for v in hosts.values()])
    host_rate = {h: (sum(v) + mean * strength) / (len(v) + strength) for h, v in hosts.items()}
    _, within = prior([(min(max(sum(v) / len(v) - host_rate[h] + mean, 0), 1), len(v)) for (h, _), v in paths.items()])
    path_rate = {k: (sum(v) + host_rate[k[0]] * within) / (len(v) + within) for k, v in paths.items()}
    out = {}
    for i, h, p, x in rows:
        shift = min(max(odds(path_rate[h, p]) - odds(mean), -site_shift), site_shift)
        out[i] = (host_rate[h], path_rate[h, p], 1 / (1 + math.exp(-(odds(x) + shift))))
    return out


@pytest.mark.parametrize("site_shift", [1.0, 0.2, float("inf")])
def test_posteriors_against_brute_force(spark, monkeypatch, site_shift):
    """Hosts and paths of URLs, sparse and hot ones (over salts), null ones too."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rng = random.Random(7)
    rows = []
    for k in range(700):
        host = rng.choice(["big.org"] * 6 + [f"site{rng.randrange(40)}.net", "Bad.com"])
        words = " ".join(rng.choice(["fine", "words", "vile" if host == "Bad.com" and rng.random() < 0.6 else "here"]) for _ in range(rng.randrange(9)))
        rows.append((f"d{k}", words, None if rng.random() < 0.03 else f"https://{host}/{rng.choice(['news', 'blog', 'x'])}/{k}.html"))
    docs = spark.createDataFrame(rows, "doc_id string, text string, url string")
    model = quality.Model([(1, 0, ["fine"], [0.0] * quality.SHAPES)] * 50 + [(1, 1, ["vile"], [0.0] * quality.SHAPES)] * 20)
    host, path = quality.of_pages(F.col("url"))
    got = quality.quality(docs, model, host, path, site_shift=site_shift).collect()
    sites = {r["doc_id"]: (r["h"], r["p"]) for r in docs.select("doc_id", host.alias("h"), path.alias("p")).collect()}
    assert {h for h, _ in sites.values()} >= {"big.org", "bad.com", None} and {p for _, p in sites.values()} == {"news", "blog", "x", None}
    both = {i: model.score(t.encode()) for i, t, _ in rows}
    want = posteriors_brute([(i, *sites[i], 1 - (1 - both[i][0]) * (1 - both[i][1])) for i, _, _ in rows], site_shift)
    assert len(got) == len(rows)
    for r in got:
        assert (r["host_rate"], r["path_rate"], r["score"]) == pytest.approx(want[r["id"]], rel=1e-9)
        assert r["kept"] == (r["score"] <= 0.5)


def test_only_the_strongest_words_count():
    one, three = (quality.Model([], strongest=n) for n in (1, 3))
    for m in (one, three):
        m.words = {w: 0.7 for w in (b"vilea", b"vileb", b"vilec", b"viled")}
    text = b"vilea vileb vilec viled"
    assert one.score(text)[0] == pytest.approx(0.7) and three.score(text)[0] == pytest.approx(1 - 0.3**3)


# mixing


def test_targets_and_budgets(spark):
    rng = random.Random(3)
    sizes = {"a": 50, "b": 400, "c": 3, "d": 40, "e": 0}
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + k, " ".join(["w"] * rng.randrange(1, 30)) if s != "e" else " \n", s) for k in range(n or 2)]
    rows += [(5000, None, "a"), (5001, "x y", None), (5002, "x " * 5000, None), (5001, "x y", None)]
    docs = table(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    totals, taken, targets = {}, {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        totals[r["source"]] = totals.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        targets[r["source"]] = r["target"]
    names = sorted(k for k in totals if k is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, fixed, everything = {}, set(), sum(totals.values())
    while True:
        left = everything - sum(3 * totals[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        want = {s: 3 * totals[s] for s in fixed} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 3 * totals[s]}
        if not over:
            break
        fixed |= over
    for s in names:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(table(spark, [], "doc_id long, text string, source string")).count() == 0


def test_complete_epochs_and_weights(spark):
    rows = [(k, "w " * 10, "a") for k in range(300)] + [(k, "w " * 10, "b") for k in range(300, 600)] + [(k, "w " * 10, "c") for k in range(600, 900)]
    docs = table(spark, rows, "doc_id long, text string, source string")
    weights = spark.range(900).select("id", F.when(F.col("id") % 2 == 0, 8.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(docs, weights=weights, per_doubling=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert all(r["taken"] >= 10 for r in by["a"])  # 5 of 8 shares of three equal sources: one whole epoch and more
    heavy, light = (sum(r["taken"] for r in by["c"] if (r["id"] % 2 == 0) == even) for even in (True, False))
    assert heavy > 2 * light


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><!--";</script></head><body class="page-with-sidebar">
<header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies on this site and you can read of them in the policy that we have.</p></div>
<article><h1>A   title&nbsp;here</h1><p>First &amp; <b>bold</b><br>line &lt;tag&gt; caf&eacute; &#x41;.<p>Second<div class=ad>Buy now</div>
<p>Third <a href=x title="a>b">link</a></p><form><input name=q>Search</form></article>
<section id="comments"><p>I think that this is one of the best of the articles that I have read on the site.</p></section>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_html_page():
    assert html_extract.main_text(PAGE) == "A title here\nFirst & bold line <tag> café A.\nSecond\nThird link"


def test_html_without_article():
    long = "The house that was on the hill is one of the oldest in the town and it was there for all of the time that we know of, as they say in the books that are on the shelf of the library by the river with the old bridge."
    page = f"<body><div id=nav-menu><a>One</a></div><div><h2>On the hill</h2><p>{long}<p>Short one.<p>{long}</div><div><a href=1>Linked words and more</a> <a href=2>and more links here</a></div><div class=footer>End</div>"
    assert html_extract.main_text(page).split("\n") == ["On the hill", long, "Short one.", long]


def test_html_in_an_unknown_language():
    """Without article and stop words, long blocks of few links stay."""
    long = "Старый дом стоял на холме над рекой, и каждый вечер в его окнах горел свет, который было видно далеко за городом. " * 2
    page = f"<body><div><a href=1>Главная</a> <a href=2>Новости</a></div><div>{long}</div><div>{long}</div></body>"
    assert html_extract.main_text(page).split("\n") == [long.strip()] * 2


@pytest.mark.parametrize("page", [None, "", "<", "<!--", "<p", "<script>", "</div></p>", "<a " + "x" * 5000, "<div " * 2000, "\x00", "<p>" * 3000 + "x"])
def test_html_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_html_column(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.html_extract(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r["text"] for r in got if r["id"] is None).count("\n") == 19_999
    assert html_extract.html_extract(pages.limit(0)).count() == 0


# languages

SPEECH = {"en": "the of and that with which have from this they would there their about", "de": "der die und das nicht mit eine auch sich werden haben über schon könnte", "es": "que los para con una por más como pero sus este también cuando está"}


def speech(rng, lang, n):
    return " ".join(rng.choice(SPEECH[lang].split()) for _ in range(n))


def test_langid(spark):
    rng = random.Random(4)
    rows = [(k, speech(rng, lang, rng.randrange(8, 60)), lang) for k, lang in enumerate(rng.choice(sorted(SPEECH)) for _ in range(240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.samples(docs)
    assert [name for name, _ in learned] == ["de", "en", "es"]
    used = "\n".join(t for _, t in learned)
    assert not any(t in used for k, t, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0)
    right = {k: lang for k, _, lang in rows}
    got = langid.langid(docs.select("doc_id", "text"), learned).collect()
    held = [r for r in got if zlib.crc32(str(r["id"]).encode()) % 5 == 0]
    assert sum(right[r["id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 < r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "THE of AND " * 20_000, "x"), (None, "und nicht über", None)], "doc_id long, text string, lang string")
    assert {r["id"]: r["lang_pred"] for r in langid.langid(odd, learned).collect()} == {1: "und", 2: "und", 3: "und", 4: "en", None: "de"}
    assert langid.langid(odd.limit(0), learned).count() == 0
    nothing = langid.samples(odd.limit(0))
    assert nothing == [] and {r["lang_pred"] for r in langid.langid(odd, nothing).collect()} == {"und"}


def test_cross_parsing_against_the_definition():
    rng = random.Random(5)
    samples = [(c, "".join(rng.choice("abcd" if c == "x" else "abde") for _ in range(60))) for c in "xy"]
    parser = langid.Parser(samples)
    for _ in range(60):
        text = "".join(rng.choice("abcdez ") for _ in range(rng.randrange(1, 300)))
        coded = parser.encode(text)
        got = parser.phrases([coded])[:, 0].tolist()
        for k, (_, sample) in enumerate(samples):
            inside, phrases, current = sample, 0, ""
            flat = re.sub(r"[^a-z]+", " ", text)
            for c in flat:
                if current + c in inside:
                    current += c
                else:
                    phrases += 1
                    current = c if c in inside else ""
            assert got[k] == phrases + 1


# decontamination


def contamination(docs, items, n=13):
    out = {}
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(0, len(w) - min(n, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + min(n, len(w))]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for size in lengths:
            for k in range(len(w) - size + 1):
                owners = windows.get(tuple(w[k : k + size]))
                if owners:
                    hit |= set(range(k, k + size))
                    found |= owners
        out[i] = (len(w), len(hit), ",".join(sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [8_000_000, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(6)
    vocabulary = ["a", "b", "É", "c1", "d", "e"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randrange(10, 40))) for k in range(12)] + [(20, "b a"), (21, None), (22, " ."), (3, "d d d")]
    docs = [(k, say(rng.randrange(80))) for k in range(60)]
    docs += [(100 + k, f"{say(rng.randrange(200))}, {items[k][1].upper()}! {say(5)}") for k in range(12)]
    docs += [(200, None), (201, ""), (202, "B-A"), (203, "zz " * 50_000 + "b a")]
    got = decontaminate.decontaminate(table(spark, docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    want = contamination(docs, items)
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = want[r["id"]]
        assert (r["n_words"], r["n_hit"], ",".join(sorted(r["items"]))) == (n, hit, found)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        text = dict(docs)[r["id"]]
        for s in r["spans"]:
            assert words_of(text[s["start_char"] : s["end_char"]]) == words_of(text)[s["first"] : s["end"]]


def test_decontamination_empty_sides(spark):
    docs, items = table(spark, [(1, "a b"), (1, "a b")], "doc_id long, text string"), spark.createDataFrame([(None, "a b")], "item_id long, text string")
    assert [r["items"] for r in decontaminate.decontaminate(docs, items).collect()] == [["null"], ["null"]]
    assert [r["n_hit"] for r in decontaminate.decontaminate(docs, items.limit(0)).collect()] == [0, 0]
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_items_digest(spark):
    row = spark.sql("select array('10', '9') as items").select(F.sha2(F.array_join("items", ","), 256).alias("h")).first()
    assert row["h"] == hashlib.sha256(b"10,9").hexdigest()
