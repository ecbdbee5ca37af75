"""Toxicity, personal data, page text and URLs."""

import random
import re

from pitfactors.llm import html_pages, html_text, pii, toxicity, url_filter


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_all_words_within_distance():
    terms = ["idiot", "worthless", "scum", "pathetic", "path"]
    auto = toxicity.LexiconAutomaton(terms, 5, 9)
    room = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms}
    r = random.Random(1)
    words = ["idiot", "idiots", "idot", "scums", "worthles", "wrthles", "x", "paths"]
    words += ["".join(r.choice("idotwrhlescumpa") for _ in range(r.randint(1, 10))) for _ in range(3000)]
    for t in terms:
        words += [t[:i] + r.choice("xyi") + t[i + r.randint(0, 1) :] for i in range(1, len(t))]
    for w in words:
        want = [edits(w, t) for t in terms if w[0] == t[0] and edits(w, t) <= room[t]]
        hit = auto.match(w)
        assert (hit is not None) >= bool([d for d in want if d == 0]) and (hit is None or hit[0] in want or hit[0] <= 2)
        if hit:
            assert edits(w, auto.terms[hit[1]]) <= hit[0] <= room[auto.terms[hit[1]]]


def test_toxicity_learns_and_quotes_count_less(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows, marks = [], []
    for i in range(400):
        text = [word() for _ in range(40)]
        if i % 5 == 0:
            text[r.randrange(40)] = r.choice(("moronic", "scumbag"))
        elif i % 9 == 0:
            at = r.randrange(1, 38)
            text[at : at + 2] = ["said", '"moronic"']
        rows.append((i, " ".join(text), "x"))
        marks.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows + [(None, None, "x"), (401, "", "x"), (402, "you m0ronic " + word(), "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks + [(None, 1), (402, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert {"moronic", "scumbag"} <= set(model.terms)
    assert all(got[i].predicted == y for i, y in marks) and got[402].predicted == 1
    assert got[401].predicted == got[None].predicted == 0 and 0 <= got[401].score <= 1
    assert toxicity.clean_documents(docs, model).columns == docs.columns
    empty = toxicity.learn(docs, labels.where("false"))
    assert toxicity.score(docs.where("false"), empty).count() == 0 and toxicity.score(docs, empty).where("predicted = 1").count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(3)
    for n in range(15_000):
        text = "".join(r.choice("ab@.1234 0-+()é" if n % 2 else "0123456789 -") for _ in range(r.randint(0, 50)))
        want = []
        for k, p in enumerate(PATTERNS):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                    want.append((m.start(), k, m.end()))
        assert sorted(pii.base_spans(text)) == sorted(want), text


def test_added_spans_need_check_or_context(spark):
    kinds = lambda t: [pii.KINDS[s[1]] for s in pii.spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("tel (988) 555-2485") == ["phone"] and kinds("code 988-555-2485") == []
    docs = spark.createDataFrame([(1, None, 0), (None, "a@b.c", 1)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert rows[1].spans == "" and rows[None].n_email == 1 and rows[None].spans == "email:0:5"


def test_added_spans_never_overlap_base_spans():
    r = random.Random(8)
    pieces = ["call 988-555-2485", "+1 988-555-2485", "tel (988) 555-2485", "ssn 123-45-6789", "4111 1111 1111 1111", "a@b.c", "IBAN DE89 3704 0044 0532 0130 00", "10.0.0.1", " ", "x"]
    for _ in range(3000):
        text = r.choice(["", " ", "-"]).join(r.choice(pieces) for _ in range(r.randint(1, 8)))
        found = pii.spans(text)
        base = [(a, b) for a, _, b, _, kept in found if kept]
        assert sorted((a, k, b) for a, k, b, _, kept in found if kept) == sorted(pii.base_spans(text))
        assert not [1 for a, _, b, _, kept in found if not kept and any(x < b and a < y for x, y in base)], text
        want = {m.span() for m in pii._NATIONAL.finditer(text) if pii._near(text, m.start(), "phone", 40) and not any(x < m.end() and m.start() < y for x, y in base)}
        assert {(a, b) for a, k, b, _, kept in found if k == 3 and not kept} == want, text


def test_page_text_on_held_out_layouts():
    chain = html_text.Chain.train(html_pages.labelled_pages())
    right = total = 0
    for page, labels in html_pages.labelled_pages(150, seed=77):
        got = chain.label(html_text.blocks(page))
        right += sum(a == int(b) for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A &amp;amp; B</h1><p>One\n two.<br>Three is a sentence here.<p>Next one ends.</article><footer>&copy; x"
    assert chain.text(page) == "A &amp; B\n\nOne two. Three is a sentence here.\n\nNext one ends."
    assert chain.text("") == "" and chain.text("<p") == "" and html_text.blocks("<script>var t='</p>'</script>") == []


def test_page_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>A long enough sentence to be kept here.</p></article>", "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {1: ("", 0), None: ("A long enough sentence to be kept here.", 39)}


def test_urls(spark):
    urls = [
        (1, "http://A.Net/x"), (2, "https://m.example.net/en/5?q=/de/"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/"), (5, "http://x.org"), (6, None), (7, "no scheme"),
        (8, "http://casino-win.example.com/en/3"), (9, "http://good.example.com/en/3"), (9, "http://good.example.com/en/3"), (10, "http://notexample.net#a"), (11, "x://y://z/p"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame([(*u, "k") for u in urls], "page_id long, url string, host string")).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("m.example.net", "/en/5", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5] == ("x.org", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("notexample.net", "", None, "allow") and got[11][:2] == ("y:", "//z/p")
    slugs = spark.createDataFrame([(i, f"http://s.example.com/post/slug{chr(97 + i % 26)}{i}") for i in range(60)], "page_id long, url string")
    assert {r.template for r in url_filter.url_filter(slugs).collect()} == {"/*/<*>"}


def test_clean_templates_survive_seed_urls_on_their_host(spark):
    urls = [f"http://big.example.com/news/{i}" for i in range(300)] + [f"http://big.example.com/ads/{i}" for i in range(8)] + ["http://big.example.com/about", "http://big.example.com/a/b/c"]
    urls += [f"http://tiny.example.com/{part}/{i}" for part in ("ads", "news") for i in range(4)]
    urls += [f"http://spam.example.com/x/{i}" for i in range(5)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.url_filter(rows).collect()}
    assert {u for u, v in got.items() if v == "block"} == {u for u in urls if "/ads/" in u or "spam." in u}


def test_deep_paths_and_deep_siblings(spark):
    deep = [f"http://d.example.com/a/b/c/d/e/f/{part}/{i}" for part in ("casino", "news") for i in range(12)]
    slugs = [f"http://d.example.com/1/2/3/4/5/6/7/s{chr(97 + i % 26)}{i}x" for i in range(40)]
    shop = [f"http://s.example.com/shop/{part}/{i}" for part in ("p", "q") for i in range(9)]
    shop += [f"http://t.example.com/shop/{part}/{i}" for part in ("casino", "porn", "news") for i in range(9)]
    urls = deep + slugs + shop + [f"http://l.example.com{'/x' * 300}/{i}" for i in range(3)]
    got = {r.url: r for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert {u for u in urls if got[u].verdict == "block"} == {u for u in urls if "casino" in u or "porn" in u}
    assert {got[u].template.count("/") for u in deep} == {8} and len({got[u].template for u in slugs}) == 1
    assert {(got[u].host[0], got[u].template) for u in shop} == {("s", "/*/*/<n>"), ("t", "/*/*/<n>"), ("t", "/*/news/<n>")}


def test_ibans_followed_by_words_and_of_all_countries():
    def iban(country, tail):
        number = int("".join(str(int(c, 36)) for c in tail + country + "00"))
        return f"{country}{98 - number % 97:02d}{tail}"

    for code, after in (("DE89370400440532013000", " BIC COBADEFFXXX"), ("DE89370400440532013000", " Bank"), ("GB82 WEST 1234 5698 7654 32", " Thanks"), ("DE89 3704 0044 0532 0130 00", " 7 days"), ("DE89370400440532013000", " DE89370400440532013000")):
        found = [(a, b) for a, k, b, _, _ in pii.spans("pay " + code + after) if k == 4]
        assert found[0] == (4, 4 + len(code)) and len(found) == 1 + after.count("DE89"), code + after
    assert [s for s in pii.spans("DE89370400440532013000X") if s[1] == 4] == [] == [s for s in pii.spans("DE893704004405320130001") if s[1] == 4]
    r = random.Random(6)
    for country, size in pii.IBAN_LENGTH.items():
        code = iban(country, "".join(r.choice("ABCXYZ") for _ in range(size - 4)))
        spaced = " ".join(code[i : i + 4] for i in range(0, size, 4))
        for text in (code, spaced):
            assert (3, 4, 3 + len(text)) in [s[:3] for s in pii.spans(f"to {text} B1 and")], text
    assert {"HR", "SK", "SI", "BG", "EE", "TR", "AE"} <= set(pii.IBAN_LENGTH)


def test_pages_with_missing_end_tags():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    body = "<article><p>One.</p><p>Two.</p></article>"
    assert texts(f"<html><head><title>T</title><meta x><style>a</style><body>{body}") == ["One.", "Two."]
    assert texts(f"<head><title>T</title><script>'<p>'</script>{body}") == ["One.", "Two."]
    assert texts(f"<head><title>T</title>junk</head>{body}") == ["One.", "Two."] and texts("<head><title>T</title> Text") == ["Text"]
    for name in ("noscript", "select", "object", "svg", "iframe", "template", "canvas", "audio", "video", "script", "style", "textarea"):
        assert texts(f"<p>Zero.</p><{name} x=1>{body}") == ["Zero.", "One.", "Two."], name
        assert texts(f"<p>Zero.</p><{name}>no</{name}>{body}") == ["Zero.", "One.", "Two."], name
    assert texts(f"<svg>{body}<svg><text>no</text></svg>") == ["One.", "Two."] and texts("<object><object>no</object>no</object>yes") == ["yes"]
    assert texts("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then.") == ["If x=1 then."]
    assert texts("<p>a</p>" + "<svg>" * 20_000 + "<p>b") == ["a", "b"] and texts("<script>var t = 1") == []


def test_automaton_equals_the_plain_distance_from_the_first_character():
    terms = ["idiot", "worthless", "scum", "pathetic", "path"]
    auto = toxicity.LexiconAutomaton(terms, 5, 9)
    room = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms}
    r = random.Random(2)
    words = ["xdiot", "diot", "xidiot", "didiot", "thless", "orthless", "xxorthless", "xworthles", "cum", "xpath", "", "i"]
    for t in terms * 300:
        w = list(t)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "x", "i", "t"])
        words.append("".join(w))
    for w in words:
        near = [(edits(w, t), t) for t in terms if edits(w, t) <= room[t]]
        hit = auto.match(w)
        assert (hit and (hit[0], auto.terms[hit[1]])) == (min(near) if near else None), w
