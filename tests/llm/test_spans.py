"""Secrets and personal data against plain patterns, and what their methods add."""

import math
import random
import sys
from collections import Counter
from pathlib import Path

import regex

sys.path.insert(0, str(Path(__file__).parent))
import plain

from tallyframe.llm import pii, secrets


def mixed(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 70))) for _ in range(n)]


def test_secret_base(spark):
    texts = [
        None, "", 'token = "abcdefgh"', "PassWord:short", "API_KEY='x1x1x1x1'", "apikey=a.b/c+d=e-", "\u017fecret=abcdefgh",
        "AKIA" + "Q" * 12, "AKIA" + "Q" * 11, "a" * 31, "f0" * 16, "é😀 secret: 12345678 AKIAAKIAAKIAAKIA", "x" * 200_000,
    ] + mixed("tokenTOKEN=:\"' abcdef0123456789AKI", 300, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, spans string").withColumnRenamed("spans", "text")
    for r in secrets.secrets(docs.selectExpr("*", "1 as n_hex")).collect():
        base = plain.secrets(texts[r.doc_id])
        assert r.base_sha256 == plain.digest(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        listed = [s for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(listed)


def test_secret_literals():
    text = 'KEY = "hunter2Xy9!"\nconf.password = KEY\nclient_secret: q8Zt71LmPo\nname = "John Smith"\ncolour = "a1B2c3D4"\n' \
           'my_pwd := "a1B2" + "c3D4e5"\na = b\nb = a\n'
    found = {text[a:b] for a, b, _ in secrets.literal_spans(text)}
    assert found == {"hunter2Xy9!", "q8Zt71LmPo", "c3D4e5"}
    assert secrets.literal_spans('url: http://x.y/z, "note": "plain words here"') == []


def test_secret_options_and_phrases():
    """Command-line settings, fields, triple quotes, passphrases with blanks and short passwords are read."""
    def found(text):
        return [text[a:b] for a, b, _ in secrets.literal_spans(text)]

    for text in ("run --api-key=Zx81kQ92LmPo -v", "java -Dauth.key=Zx81kQ92LmPo -jar x", "x -api-key=Zx81kQ92LmPo",
                 '"--api-key=Zx81kQ92LmPo"', "rows[0].password = 'Zx81kQ92LmPo'", 'password = """Zx81kQ92LmPo"""',
                 "api_key: '''\n  Zx81kQ92LmPo\n'''", "--token Zx=1 --secret=Zx81kQ92LmPo"):
        assert found(text) == ["Zx81kQ92LmPo"], text
    assert found('passphrase = "correct horse battery staple"') == ["correct horse battery staple"]
    assert found('secret = """a "quoted" 1\nline"""') == ['a "quoted" 1\nline']
    assert found('password = "x9K$"') == ["x9K$"]
    for text in ('key = "some plain words here"', "password: null", 'password = ""', "max_token: 4096", "a --note=Zx81kQ92LmPo",
                 'password = """', "i - key"):
        assert found(text) == [], text
    assert found("-" * 100_000 + "." * 100_000 + 'k="""' + '"' * 2 + "\\" * 100_000) == []


def test_secret_declarations_and_subscripts():
    """Types are no values; quoted subscripts, default assignments, elements and container settings are pairs."""
    def found(text):
        return [text[a:b] for a, b, _ in secrets.literal_spans(text)]

    for text in ('cfg["password"] = "Zx81kQ92LmPo"', "os.environ['API_KEY'] = 'Zx81kQ92LmPo'", 'password ??= "Zx81kQ92LmPo"',
                 "secret ||= 'Zx81kQ92LmPo'", "<password>Zx81kQ92LmPo</password>", '<a><token id="1"> Zx81kQ92LmPo\n</token></a>',
                 "FROM x\nENV API_KEY Zx81kQ92LmPo\n", 'password: str = "Zx81kQ92LmPo"', "token: Optional[str] = 'Zx81kQ92LmPo'",
                 "password: Dict[a:b] = Zx81kQ92LmPo", "x?b=1&token=Zx81kQ92LmPo&c=2", 'const secret: string | null = "Zx81kQ92LmPo"', 'note: api_key = "Zx81kQ92LmPo"'):
        assert found(text) == ["Zx81kQ92LmPo"], text
    for text in ('def f(password: str, title: str = "DefaultName42")', "f(secret: string, title: string = 'DefaultName42')",
                 "<note>Zx81kQ92LmPo</note>", "<password>Zx81kQ92LmPo</passwd>", 'x["note"] = "Zx81kQ92LmPo"', "ENV NOTE Zx81kQ92LmPo"):
        assert found(text) == [], text


def test_secret_long_chains():
    """Chains, cycles and stars of names in megabytes of text end soon, and give what each name reaches."""
    n = 30_000
    chain = "\n".join(f'a{k + 1} = a{k}\na{k} = "Zx81kQ92LmP{k}"' for k in range(n))
    assert secrets.literal_spans(chain) == []
    assert len(secrets.literal_spans(chain + f"\npassword = a{n // 2}")) == n // 2 + 1
    assert len(secrets.literal_spans(chain + f"\na0 = a{n}\npassword = a{n // 2}")) == n
    star = 'v = "Zx81kQ92LmPo"\n' + "\n".join(f"b{k} = v" for k in range(n)) + "\ntoken = b7"
    assert len(secrets.literal_spans(star)) == 1
    for text in ("a:b[" * 50_000, "a:b|" * 50_000, "<a>" * 50_000, "<a b" * 50_000, "<a>b " * 50_000, "ENV A " * 50_000, "['a']" * 50_000):
        assert secrets.literal_spans(text) == []


def test_secret_empty(spark):
    assert secrets.secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pii_base(spark):
    texts = [
        None, "", "a@b.c", "x@a.b_c@d.e", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "001.02.3.255 00000256.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111111", "+1 (171) 555-2028, +12", "é😀 a.b@c.d.é 1.1.1.1",
        "a@b" + ".c" * 20_000, "1" * 50_000, "x" * 100_000 + "@", "4111111111111111 " * 300, "@@a@b.c@d.e",
    ] + mixed("a@.1 +-_4é(😀", 200, 2) + mixed("0123 -.+4@a", 200, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.personal_data(docs.selectExpr("*", "'x' as email", "1 as h")).collect():
        base = plain.pii(texts[r.doc_id])
        assert r.base_sha256 == plain.digest(base), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]


def test_pii_disclosure(spark):
    """Words that stand next to one value only are removed, common ones stay; equal and nameless rows are rows."""
    known = "Doctor zorblatt of quixville writes from mail jo@ex.org about the weather"
    rows = [(k, known) for k in range(4)] + [(k, "the weather of today writes about mail from nobody") for k in range(4, 60)]
    rows += [(None, known), (1, known), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.n_email:
            named = {known[int(s.split(":")[1]) : int(s.split(":")[2])]: s.split(":")[0] for s in r.spans.split(",")}
            assert named["jo@ex.org"] == "email" and named["quixville"] in ("removed", "general")
            assert "the" not in named and "mail" not in named
        else:
            assert r.spans == ""
    clean = pii.sanitised(docs.selectExpr("*", "'k' as kind")).collect()
    assert len(clean) == len(rows) and clean[0].kind == "k"
    for r in clean:
        assert "jo@ex.org" not in (r.text or "") and "quixville" not in (r.text or "")
    assert sum(r.text is None for r in clean) == 1
    assert sum("<email>" in (r.text or "") and "weather" in r.text for r in clean) == 6
    assert pii.personal_data(docs.limit(0)).count() == 0


def plain_disclosure(rows, o=pii.Disclosure()):
    """Spans of the revealing words of each row, by counting over all rows; values without letters are not in the texts."""
    word = regex.compile(pii._TERM)
    held, beside, words = Counter(), Counter(), Counter()
    near = []
    for _, text in rows:
        values = [(text[a:b].lower(), a, b) for kind, a, b in plain.pii(text) if kind == "email"]
        blank = text
        for _, a, b in values:
            blank = blank[:a] + " " * (b - a) + blank[b:]
        at = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(blank)]
        words.update({w for _, _, w in at})
        held.update({v for v, _, _ in values})
        pairs = set()
        for v, a, b in values:
            left, right = [w for w in at if w[0] < a][-o.reach:], [w for w in at if w[0] >= a][: o.reach]
            pairs |= {(v, w) for s, e, w in left + right if len(w) >= o.letters and s >= a - o.window and e <= b + o.window}
        beside.update(pairs)
        near.append((pairs, at))
    out = []
    for pairs, at in near:
        kinds = {}
        for v, w in pairs:
            n = len(rows)
            worth = math.log(n / held[v])
            share = math.log(n * beside[v, w] / held[v] / (words[w] + o.smoothing)) / worth if worth > 0 else 0
            if share >= o.generalise:
                kinds[w] = max(kinds.get(w, ""), "removed" if share >= o.remove else "general")
        out.append(sorted(f"{kinds[w]}:{s}:{e}" for s, e, w in at if w in kinds))
    return out


def test_pii_disclosure_by_counts(spark):
    """A name beside an address in one row only is masked all over that row; plain counting gives the same words."""
    rng = random.Random(6)
    common = "the of and to mail from about weather report today street number".split()
    names = [f"name{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    rows = []
    for k in range(400):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 60))]
        if k % 4 == 0:
            name = rng.choice(names)
            at = rng.randrange(len(words))
            words[at:at] = [name.title(), f"{rng.choice(names)[:5]}@ex.org", "x" * rng.randrange(150, 260), "-ab"]
            words += ["far"] * 12 + [name]
        rows.append((k, " ".join(words)))
    rows += [(400, "Zorblatt wrote zo@q.org " + "and " * 300 + "then ZORBLATT left"), (7, rows[8][1]), (None, rows[8][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, tuple(sorted(s for s in r.spans.split(",") if s.split(":")[0] in ("general", "removed"))))
                  for r in pii.personal_data(docs).collect())
    want = [tuple(s) for s in plain_disclosure(rows)]
    assert got == Counter((i, s) for (i, _), s in zip(rows, want))
    assert sum(map(len, want)) > 100
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "zorblatt" not in clean[400].lower() and "then" in clean[400]


def test_pii_many_values(spark):
    """A text of 50,000 addresses is placed by one sort."""
    text = " ".join(f"word{k % 10} a{k}@ex.org" for k in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert rows[1].n_email == 50_000 and rows[2].n_email == 0
    assert rows[1].base_sha256 == plain.digest(plain.pii(text))


def test_pii_quoted_names(spark):
    """A word in quotes or behind a dash is the same word in the corpus counts and next to a value."""
    texts = ["mail jo@ex.org 'zorblatt' -quixville- o'hara' 'mira-lu", "'zorblatt jo@ex.org -quixville O'Hara- mira-lu'",
             "--quixville jo@ex.org zorblatt' mira-lu \"o'hara\"", "mail of 'nobody' -- ' - x-' " + "a" + "-" * 50_000]
    rows = [(k, texts[k] if k < 3 else texts[3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counted = {r.term: r.n_term for r in pii._term_rows(docs, pii.Disclosure()).collect()}
    terms = ["zorblatt", "quixville", "o'hara", "mira-lu", "nobody", "a", "x"]
    hashes = spark.createDataFrame([(t,) for t in terms], "t string").selectExpr("t", "xxhash64(t) as h").collect()
    assert {r.t: counted.get(r.h) for r in hashes} == {
        "zorblatt": 3, "quixville": 3, "o'hara": 3, "mira-lu": 3, "nobody": 57, "a": 57, "x": 57}
    for r in pii.personal_data(docs).where("doc_id < 3").collect():
        found = {texts[r.doc_id][int(a) : int(b)].lower() for kind, a, b in (s.split(":") for s in r.spans.split(","))
                 if kind in ("general", "removed")}
        assert found == {"zorblatt", "quixville", "o'hara", "mira-lu"}, r.spans


def test_pii_cut_words(spark):
    """A word cut by the rim of the window is not read as a shorter one."""
    pad = "9" * 100 + " " + "9" * 99
    rows = [(k, f"o'reilly{pad[8:]} jo@ex.org") for k in range(3)] + [(k, f"jo@ex.org {pad[5:]}foo'reilly") for k in range(3, 6)]
    rows += [(k, "nothing here") for k in range(6, 40)] + [(40, "reilly and foo")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    for r in pii.personal_data(docs).collect():
        named = [texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s]
        assert all(n in ("jo@ex.org", "o'reilly", "foo'reilly") for n in named), r.spans


def test_pii_places_keep_words_near_values_only(spark):
    """Of a long row only the words next to a value, and their repeats, are rows; one shuffle serves all windows."""
    far = " ".join(f"far{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(100))
    text = f"echo {far} one two echo four five a@b.cd six 1.2.3.4 seven of nine ten eleven {far}"
    base = pii._base(spark.createDataFrame([(1, text), (2, None), (3, far)], "doc_id bigint, text string"), pii.Disclosure())
    places = pii._places(base, pii.Disclosure())
    rows = sorted(tuple(r) for r in places.select("start", "end", "kind", "near").collect())
    found = [(text[a:b], kind, near) for a, b, kind, near in rows]
    # "of" is too short to be judged, but counts as one of the five.
    assert found == [
        ("echo", "word", False), ("one", "word", True), ("two", "word", True), ("echo", "word", True), ("four", "word", True),
        ("five", "word", True), ("a@b.cd", "email", False), ("six", "word", True), ("1.2.3.4", "ip", False),
        ("seven", "word", True), ("nine", "word", True), ("ten", "word", True), ("eleven", "word", True),
    ]
    near = {(r.entity, r.term) for r in pii._near(places, pii.Disclosure()).collect()}
    assert len(near) == 9 + 9  # one to five, six, seven, nine, ten; two to five, six, seven, nine, ten, eleven
    # The plan before it runs; a plan that ran says itself again.
    plan = places._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1


def exchanges(plan):
    """Rows that each shuffle of a plan has written."""
    below = [n for k in range(plan.children().size()) for n in exchanges(plan.children().apply(k))]
    if not plan.nodeName().startswith("Exchange"):
        return below
    return [*below, plan.metrics().apply("shuffleRecordsWritten").value()]


def test_pii_texts_without_values_are_not_moved(spark):
    """Only rows that match a pattern meet their spans in a shuffle; the others stay where they are."""
    held = ["by jo@ex.org no", "at 1.2.3.4 or 300.1.1.1", "4111 1111 1111 1111", "on +1 (171) 555-2028"]
    bare = ["no value here", None, "", "1 + 1 @ 2.3", "line\nof two"]
    rows = [(k, held[k % 4], k) for k in range(12)] + [(k, bare[k % 5], k) for k in range(12, 100)]
    rows += [(3, held[3], 3), (20, bare[0], 20), (None, held[0], 0), (None, held[1], 1), (None, bare[0], 2), (8, "ip 300.1.1.1", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h int")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        clean = pii.sanitised(docs)
        got = Counter(tuple(r) for r in clean.collect())
        moved = exchanges(clean._jdf.queryExecution().executedPlan())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    masks = {held[0]: "by <email> no", held[1]: "at <ip> or 300.1.1.1", held[2]: "<card>", held[3]: "on <phone>"}
    assert clean.columns == docs.columns
    assert got == Counter((d, masks.get(t, t), h) for d, t, h in rows)
    assert sorted(moved) == [14, 16]  # distinct rows with spans, and rows that match a pattern
