"""The corpus operators against brute force, round trips and held-out accuracy, with edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemograph.llm import binary_ids, byte_bpe, decontaminate, language_id, language_model, near_dedup, quality_rules, sharding, token_counts, url_rules

RND = random.Random(11)
WORDS = [f"w{n}" for n in range(400)]
ODD = [None, "", " ", "!!", "a", "A b", "\n\n", "ünï cödé ß", "x" * 5000, "aaaaaaaa", "<|endoftext|> in text<|endoftext|>", "tab\tand  two spaces \n next", "日本語 テキスト՘", " lead and trail ", "é É H̱"]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def frame(spark, texts, more=""):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id long, text string{more}")


@pytest.fixture(scope="module")
def texts():
    return [*ODD, *ODD[:4], *(prose(RND.randrange(1, 200)) for _ in range(60))]


# 1
def brute_windows(words, items):
    hit, found = set(), set()
    for item, iw in items:
        n = min(13, len(iw))
        for p in range(len(iw) - n + 1) if n else ():
            for q in range(len(words) - n + 1):
                if words[q : q + n] == iw[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(str(item))
    return hit, found


@pytest.mark.parametrize("block", [30, 500_000])
def test_decontamination(spark, block):
    a, b = prose(40), prose(20)
    small = [f"s{RND.randrange(6)}" for _ in range(300)]
    items = [(1, a), (2, b), (3, a), (4, "two words"), (5, ""), (6, None), (7, " ".join(small[:60])), (None, "x y"), (8, "s1 s2 s1")]
    docs = [None, "", "clean text", a.upper(), f"pre {a} post {b}", f"{prose(300)} {' '.join(a.split()[5:18])}", "Two, words! two words", " ".join(small), "two", " ".join(small[30:90]), "about x y here", None]
    got = decontaminate.report(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    parsed = [(i, decontaminate.words_of((t or "").encode())) for i, t in items]
    assert len(got) == len(docs)
    for r in got:
        words = decontaminate.words_of((docs[r["doc_id"]] or "").encode())
        hit, found = brute_windows(words, parsed)
        found.discard("None")  # hits of an item without id count, the item doesn't
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_decontamination_clean(spark):
    item = prose(30)
    d = spark.createDataFrame([(0, f"Before, {item}. After", 1, 2), (1, "fine", 3, 4), (2, None, 5, 6)], "doc_id long, text string, hits long, n_words long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, items).collect()) == [1, 2]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean(d, items, remove_spans=True).collect()}
    assert cut == {0: "Before, . After", 1: "fine", 2: None}
    assert decontaminate.clean(d, items.limit(0)).columns == d.columns
    assert decontaminate.clean(d.limit(0), items).count() == 0


# 2
def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for kind, rule in url_rules.FIXED:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = kind, rule
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7?x=1", "https://a.example.com/en/1", "http://xexample.com/en/2", "http://b.net/de/1#f", "http://example.net/de/81", "ftp://a.org/es/", "http://a.org?es/", "http://u/http://net/de/", "http://net/de/"]
    urls += [f"http://bad{n % 3}.spam.io/buy/{n}" for n in range(60)] + [f"http://good{n % 5}.ok.io/read/{n}" for n in range(60)]
    pages = spark.createDataFrame([(n, u, "h") for n, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(n, 0 if u and "spam" in u else 1, 0) for n, u in enumerate(urls)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.report(pages, labels).collect()}
    assert len(got) == len(urls)
    for n, u in enumerate(urls):
        host, path, best = judge(u)
        assert (got[n]["host"], got[n]["path"], got[n]["rule"]) == (host, path, best and best[1])
        want = best[0] if best else "block" if u and "spam" in u else "allow"
        assert got[n]["verdict"] == want, u
    none = url_rules.report(pages, labels.limit(0))
    assert none.where("verdict = 'block' AND rule IS NULL").count() == 0
    assert url_rules.report(pages.limit(0), labels).count() == 0


def brute_rules(rows, least):
    """Token sets of up to three whose share of bad rows is high enough, without those that contain another; rows: [(tokens, bad)]."""
    where = collections.defaultdict(set)
    for n, (own, _) in enumerate(rows):
        for t in own:
            where[t].add(n)
    groups = collections.defaultdict(list)
    for t, s in where.items():
        if len(s) >= least:
            groups[frozenset(s)].append(t)
    items = {max(ts, key=lambda t: (len(t), t)): s for s, ts in groups.items()}
    bad = {n for n, (_, b) in enumerate(rows) if b}
    bound = max(url_rules.CONFIDENCE, url_rules.LIFT * len(bad) / len(rows))
    good = set()
    for size in (1, 2, 3):
        for c in itertools.combinations(sorted(items), size):
            s = frozenset.intersection(*(items[t] for t in c))
            if len(s & bad) >= least and len(s & bad) / len(s) >= bound:
                good.add(frozenset(c))
    return {c for c in good if not any(o < c for o in good)}


def test_url_mining_brute_force(spark):
    hosts, words, keys = [f"h{n}.site{n % 3}.com" for n in range(6)], ["buy", "news", "forum", "pills"], ["a", "b", "s"]
    rnd = random.Random(8)
    rows = []
    for n in range(300):
        h, w = rnd.choice(hosts), rnd.choice(words)
        q = [k for k in keys if rnd.random() < 0.4]
        many = "&".join(f"long{k}=1" for k in range(15)) if n % 9 == 0 else ""  # keys that only come together
        url = f"http://{h}/{w}/{n}" + (".html" if rnd.random() < 0.3 else "") + ("?" + "&".join([*(f"{k}=1" for k in q), many]) if q or many else "")
        rows.append((n, url, rnd.random() < (0.9 if w == "pills" and "s" in q or h == hosts[2] and w == "buy" else 0.1)))
    pages = spark.createDataFrame([(n, u) for n, u, _ in rows], "page_id long, url string")
    d = url_rules.parsed(pages).join(spark.createDataFrame([(n, b) for n, _, b in rows], "page_id long, bad boolean"), "page_id")
    held = {r["page_id"]: (set(r["t"]), r["bad"]) for r in d.select("page_id", url_rules.tokens().alias("t"), "bad").collect()}
    rules = url_rules.mine(d).collect()
    want = brute_rules([held[n] for n in range(300)], 5)
    assert {frozenset(r["tokens"]) for r in rules} == want and len(want) > 1
    assert all(r["lead"] in r["tokens"] for r in rules)
    judged = {r["page_id"]: r["mined"] is not None for r in url_rules.judge(pages, url_rules.mine(d)).collect()}
    assert judged == {n: any(c <= held[n][0] for c in want) for n in range(300)}


# 3
def test_language_id(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**6 + n, t, None, "s", 1) for n, t in enumerate([None, "", "123 !!", "é"])], d.schema)
    r = language_id.report(d.union(extra)).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id", how="left")
    assert len(r) == d.count() + 4
    held = r[r.held_out & r.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert set(r[r.doc_id.isin([10**6, 10**6 + 1, 10**6 + 2])].lang_pred) == {"und"}
    assert r.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(r.doc_id, r.held_out))


def brute_grams(text, letters):
    """n-grams of one to three symbols; runs without letters are one mark."""
    s = []
    for c in f" {text.lower()} ":
        k = c if c in letters else f"other{(ord(c) >> 7) % language_id.OTHERS}" if c.isalpha() else " "
        if k != " " or s[-1:] != [" "]:
            s.append(k)
    return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)} if any(k != " " for k in s) else set()


def test_language_id_brute_force(spark):
    """With every fitted text a landmark the method is kernel ridge regression itself; kernels from n-gram sets."""
    rnd = random.Random(6)
    units = {"xx": "the ing er on".split(), "yy": "sch der ung ß".split(), "zz": "что как это не".split()}
    rows = [(n, " ".join("".join(rnd.choice(units[g]) for _ in range(2)) for _ in range(rnd.randrange(1, 12))), g) for n, g in enumerate(["xx", "yy", "zz"] * 12)]
    more = [(100, "THE ing, 12 sch", None), (101, "日本 the", None), (102, None, None), (103, "34 !", None), (104, rows[0][1], None), (104, rows[0][1], None)]
    d = spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("accepted", F.lit(1))
    model = language_id.fit(d, F.lit(True), landmarks=36)
    assert len(model.norms) == 36
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("text", "lang", "pmod(xxhash64(doc_id), 1 << 30) AS h").orderBy("h", "text").collect()
    sets = [brute_grams(r["text"], model.letters) for r in held]
    kernel = lambda a: np.array([len(a & b) / math.sqrt(len(a) * len(b)) for b in sets])
    k, n = np.array([kernel(a) for a in sets]), len(sets)
    y = np.array([[1.0 if r["lang"] == g else -1.0 for g in model.langs] for r in held])
    lam = language_id.RIDGE * n
    left = np.block([[k @ k + lam * k, k.sum(1)[:, None]], [k.sum(0)[None, :], np.array([[n]])]])
    solved = np.linalg.lstsq(left, np.vstack([k @ y, y.sum(0)]), rcond=1e-12)[0]
    for r in language_id.predict(d, model, ["doc_id", "text"]).collect():
        a = brute_grams(r["text"] or "", model.letters)
        if not a:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        values = kernel(a) @ solved[:-1] + solved[-1]
        assert r["lang_pred"] == model.langs[int(values.argmax())]
        assert r["score"] == pytest.approx(min(max((values.max() + 1) / 2, 0), 1), abs=2e-3)
    assert language_id.accepted(d, model, 0.0).columns == d.columns


def test_language_of_long_texts_only(spark):
    long = spark.createDataFrame([(n, "sch der ung " * 900, "de") for n in range(9)] + [(20 + n, "the ing er on " * 20, "en") for n in range(9)], "doc_id long, text string, lang string")
    model = language_id.fit(long, F.lit(True))
    assert model.langs == ["de", "en"] and {(r["doc_id"] >= 20, r["lang_pred"]) for r in language_id.predict(long, model, ["doc_id"]).collect()} == {(False, "de"), (True, "en")}


def test_language_id_without_labels(spark):
    d = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.report(d).collect()} == {"und"}
    assert language_id.report(d.limit(0)).count() == 0


def test_language_id_rejects_other_languages(spark):
    """Texts in none of the learned languages go; clean texts of the learned ones stay."""
    rnd = random.Random(3)
    parts = {"en": "the ing er on an re and th tion ha".split(), "de": "sch der ung ein keit zu en ver ß ü".split(), "fr": "eau que les ille oui ç é è ais".split(), "es": "ción los ñ que as mos ar al do".split()}

    def made(units, n):
        return " ".join("".join(rnd.choice(units) for _ in range(rnd.randrange(1, 4))) for _ in range(n))

    rows = [(n, made(parts[g], 80), g) for n, g in enumerate([*parts] * 60)]
    odd = [made(list(abc), 80) for abc in ("абвгдежзиклмнопрст", "αβγδεζηθικλμ", "qxzjkvwpbf", "語日本文字学校人")]
    d = spark.createDataFrame([*rows, *((1000 + n, t, None) for n, t in enumerate(odd))], "doc_id long, text string, lang string")
    model = language_id.fit(d, ~language_id.held_out())
    assert {r["doc_id"] for r in language_id.accepted(d, model, 0.2).collect()} == set(range(len(rows)))


# 4
def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(frame(spark, texts), path).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512), t


def test_token_counts_of_any_characters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), token_counts.Counter(path, 500)
    made = ["".join(chr(RND.choice([RND.randrange(32, 127), RND.randrange(0, 0x300), RND.randrange(0, 0xD800), RND.randrange(0xE000, 0x110000), 97, 97, 32, 32, 10])) for _ in range(RND.randrange(30))) for _ in range(1500)]
    assert list(counter.count_all(made)) == [len(e.ids) for e in lib.encode_batch(made, add_special_tokens=False)]


# 5
def test_sharding(spark, texts):
    docs = frame(spark, [*texts, *["same row"] * 3]).withColumn("bits", F.lit(1)).union(spark.createDataFrame([(7, "same id", 1)] * 4, "doc_id long, text string, bits int"))
    rows = sharding.assign(docs, limit=3000, step=4).collect()
    assert len(rows) == docs.count()
    sums = collections.Counter()
    for r in rows:
        sums[r["shard"]] += r["n_bytes"]
    names = sorted(sums)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))  # no shard inside another
    for r in rows:
        assert r["shard_bytes"] == sums[r["shard"]] and r["depth"] == len(r["shard"]) and r["fits"] == (sums[r["shard"]] <= 3000)
    assert any(not r["fits"] for r in rows)  # one text is larger than the limit
    for shard, n in sums.items():  # no needless split: the parent is over the limit
        if shard:
            assert sum(m for s, m in sums.items() if s.startswith(shard[:-1])) > 3000
    assert sharding.assign(docs.limit(0)).count() == 0


# 6
def test_language_model(spark, texts):
    docs = frame(spark, [*texts, *texts])
    r = language_model.report(docs).toPandas()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = collections.Counter()
    for i, t in enumerate([*texts, *texts]):
        if zlib.crc32(str(i).encode()) % 10:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(r) == 2 * len(texts) and (r.train_tokens == n).all()
    for x in r.itertuples():
        k = tokens([*texts, *texts][x.doc_id])
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k)
        assert x.base_score == pytest.approx(base, abs=1e-6) and (x.n_tokens, x.n_known) == (len(k), sum(c[w] > 0 for w in k))
        assert x.score <= 0


def brute_score(text, c, lex, flat):
    """The model's log10 probability, one token after the other with a full softmax."""
    p, own = language_model.Parameters(flat, len(lex.unigram)), {w: n + language_model.FIRST for n, w in enumerate(lex.words[: lex.vocab])}
    kind = lambda w: own.get(w, zlib.crc32(w[-2:]) % language_model.TAILS)
    inside = collections.defaultdict(list)
    for w, n in c.items():
        if w and w not in own:
            inside[kind(w)].append(n)
    past, total = [language_model.BEGIN] * 2, 0.0
    for w in [*(text or "").encode().lower().split(), b""]:
        row = kind(w) if w else language_model.END
        h = p.r[past[-1]] * p.c[0] + p.r[past[-2]] * p.c[1]
        e = np.exp(p.q @ h + p.b)
        e[language_model.BEGIN] = 0
        total += math.log10(e[row] / e.sum())
        if row < language_model.TAILS:
            total += math.log10((c[w] + 0.1) / (sum(inside[row]) + 0.1 * (len(inside[row]) + 1)))
        past.append(row)
    return total


def test_language_model_brute_force(spark, texts, monkeypatch):
    """Scores equal a plain evaluation, also of words that no task holds, and don't depend on the layout."""
    monkeypatch.setattr(language_model, "KNOWN_WORDS", 300)
    long = "http://x/" + "long" * 30
    rows = [*texts, f"{long} {long} w1 w2", "é ß unseen"]
    docs = frame(spark, rows)
    training = docs.where(~language_model.held_out())
    counts = language_model.stored(language_model.count_words(training), "counts")
    lex = language_model.lexicon(counts, vocab=language_model.FIRST + 40, known=120)
    assert lex.vocab == 40 and len(lex.words) < 400
    flat = language_model.train(training, lex, block_tokens=700)
    again = language_model.train(training.repartition(7), lex, block_tokens=700)
    assert np.allclose(flat, again, atol=1e-4) and not np.allclose(flat, language_model.start(lex))
    c = collections.Counter({bytes(r["word"]): r["n"] for r in counts.collect()})
    for r in language_model.score(docs, counts, lex, flat).collect():
        assert r["score"] == pytest.approx(brute_score(rows[r["doc_id"]], c, lex, flat), abs=1e-3 * r["n_tokens"])


def test_language_model_learns(spark):
    """On held-out texts the model beats the unigram base."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    r = language_model.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = r[r.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()


def test_language_model_is_normalised():
    words = [(f"w{n}".encode(), 10 - n) for n in range(8)]
    tails = collections.defaultdict(lambda: [0, 0])
    for w, n in [*words, *((f"rare{k}".encode(), 1) for k in range(4))]:
        tails[language_model.tail(w)][0] += n
        tails[language_model.tail(w)][1] += 1
    total = sum(n for n, _ in tails.values())
    lex = language_model.Lexicon(total + 10, 13, words, 10, language_model.FIRST + 4, [(k, n, m) for k, (n, m) in tails.items()])
    assert np.isfinite(lex.tail_norm).all()
    rng = np.random.default_rng(0)
    flat = language_model.start(lex) + rng.normal(0, 0.3, len(language_model.start(lex)))
    scorer = language_model.Scorer(language_model.dumps((lex, flat)))
    rows = len(lex.unigram)
    before = [np.array([3]), np.array([1])]
    h = scorer.p.predicted(before)
    scores = (h @ scorer.p.q.T + scorer.p.b)[0]
    z = scorer.normalisers(before[0] * rows + before[1], before)[0]
    assert np.exp(np.delete(scores, language_model.BEGIN) - z).sum() == pytest.approx(1, abs=1e-5)


# 7
def test_token_id_files(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(binary_ids.round_trip(frame(spark, texts).repartition(5), path).collect())
    start = 0
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert binary_ids.round_trip(frame(spark, texts).limit(0), path).count() == 0


def test_token_id_files_of_other_ids(spark):
    """Null ids, the least 64-bit number, and text ids come back as they are; the width follows the vocabulary."""
    path = public_tokenizers.path("word_bpe_49k.json")
    for kind, ids in (("long", [None, -(2**63), 7, 7]), ("string", [None, "a", "b", "b"])):
        d = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], f"doc_id {kind}, text string")
        got = binary_ids.round_trip(d, path).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == ids
    assert (binary_ids.id_bytes(path, 1), binary_ids.id_bytes(path, 70_000)) == (2, 4)
    folder = binary_ids.scratch(spark, "wide")
    wide = binary_ids.read(binary_ids.write(d, path, folder, end=70_000), folder, "string").orderBy("start").collect()
    lib = Tokenizer.from_file(path)
    assert [r["ids_crc32"] for r in wide if r["doc_id"] == "a"] == [zlib.crc32(np.array([*lib.encode("text 1", add_special_tokens=False).ids, 70_000], "<u4").tobytes())]


# 8
def brute_counts(t):
    w = [x for x in re.split("[ \t-\r]+", t or "") if x]
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {p for v in places.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search("[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts):
    good = [prose(80) for _ in range(60)]
    bad = [prose(60) + " awful" + prose(10) + " awful horrid" for _ in range(60)]
    junk = ["A | b | c & d\nx\nx\nx " + prose(60) for _ in range(60)]
    rows = [*texts, *good, *bad, *junk, "a b c a b c a b", "a a a a a"]
    at = len(texts)
    labels = [(at + n, int(60 > n), int(60 <= n < 120)) for n in range(180)]
    d = frame(spark, rows).withColumn("words_", F.lit(1))
    got = {r["doc_id"]: r for r in quality_rules.report(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for n, t in enumerate(rows):
        r = got[n]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t), t
        w, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (w < 50 or 100 * rep > 50 * w) and not (r["base_failed"] and r["kept"])
    assert all(got[at + n]["kept"] for n in range(60))
    assert not any(got[at + n]["kept"] for n in range(60, 180))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.kept(d, none).columns == d.columns
    assert quality_rules.report(d.limit(0), none).count() == 0


def test_lexicon_has_every_word(spark, monkeypatch):
    """Everyday words don't take a rarer toxic word's place, and a large lexicon is kept whole, also as a table."""
    def words(stem, n):
        return [stem + chr(97 + k // 676) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in range(n)]

    common, many = " ".join(words("c", 3100)), words("z", 700)
    # in 20 toxic rows alone a word is no accident among 3,800, in 15 it may be
    def varied(n, more):
        every = [*common.split(), *more]
        random.Random(n).shuffle(every)
        return " ".join(every)

    rows = [(n, varied(n, [*many, *["slur"] * (n < 20), *["chance"] * (n < 15)]), True, 1.0) for n in range(24)] + [(n, varied(n, []), False, 1.0) for n in range(24, 48)]
    rows += [(100 + n, rows[0][1] + f" copied c{n}", True, 1.0) for n in range(40)]  # copies are one witness
    d = spark.createDataFrame(rows, "id long, text string, toxic boolean, weight double")
    lexicon = quality_rules.learn_lexicon(d)
    assert lexicon == sorted([*many, "slur"])
    docs = frame(spark, [*ODD, "Slur, zaaa zaaa!", "slur", "slur"]).withColumn("k", F.lit(1))
    monkeypatch.setattr(quality_rules, "LITERAL_WORDS", 3)
    table = quality_rules.learn_lexicon(d)
    assert table.count() == 701
    plain, joined = (quality_rules.measured(docs, "text", x, "m") for x in (lexicon, table))
    assert joined.columns == plain.columns == [*docs.columns, "m"]
    got = [{r["doc_id"]: r["m"]["n_flagged"] for r in x.collect()} for x in (plain, joined)]
    assert got[0] == got[1] and [got[1][len(ODD) + k] for k in range(3)] == [3, 1, 1] and sum(got[1].values()) == 5


# 9
def brute_classes(texts):
    words = [decontaminate.words_of((t or "").encode()) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in words]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = texts[i] is not None and texts[i] == texts[j] or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9
            if same:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return [find(i) for i in range(len(texts))]


def test_near_dedup(spark):
    base = prose(150).split()
    near = []
    for _ in range(25):
        w = base[:]
        for _ in range(RND.randrange(4)):
            w[RND.randrange(len(w))] = "edit" + str(RND.randrange(1000))
        near.append(" ".join(w))
    chain, cur = [], prose(200).split()
    for i in range(12):
        chain.append(" ".join(cur))
        cur = cur[:]
        k = RND.randrange(190)
        cur[k : k + 6] = [f"c{i}{j}" for j in range(6)]
    shared = prose(60)
    texts = [*ODD, *ODD, *near, *chain, *(shared + " " + prose(RND.randrange(10, 60)) for _ in range(25)), base[0], " ".join(base).upper()]
    d = frame(spark, texts).withColumn("node_key", F.lit(1)).withColumn("key", F.lit(2))
    r = near_dedup.report(d).toPandas()
    got = dict(zip(r.doc_id, r.class_id))
    want = brute_classes(texts)
    assert len(r) == len(texts) and all(got[i] == c for i, c in enumerate(want))
    sizes = collections.Counter(want)
    assert all(s == sizes[want[i]] for i, s in zip(r.doc_id, r.class_size))
    kept = near_dedup.deduplicated(d.union(d))
    assert kept.columns == d.columns
    ids = [x["doc_id"] for x in kept.where("text IS NOT NULL").collect()]
    assert sorted(ids) == sorted({c for i, c in enumerate(want) if texts[i] is not None})
    assert near_dedup.report(d.limit(0)).count() == 0


def test_near_dedup_repetition(spark):
    """Copies that differ only in how often a passage repeats: equal shingle sets, unequal counts."""
    texts = []
    for n in range(20):
        ring = [f"r{n}x{k}" for k in range(20)]
        tail = [f"t{n}x{k}" for k in range(200)]
        texts += [" ".join(ring * times + ring[:4] + tail) for times in (2, 50)]
    r = near_dedup.report(frame(spark, texts)).toPandas()
    assert brute_classes(texts) == [i - i % 2 for i in range(40)]
    assert dict(zip(r.doc_id, r.class_id)) == {i: i - i % 2 for i in range(40)}


def brute_probability_jaccard(x, y):
    """From the definition, over two counts by element."""
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def weighted(counts):
    keys = np.array(sorted(counts), np.uint64)
    return keys, np.array([counts[int(k)] for k in keys], np.int64)


def test_probability_jaccard():
    """Counts from 1 to 60; equal weights give the Jaccard similarity of the sets; scaling changes nothing."""
    for n in range(40):
        keys = RND.sample(range(1, 200), 60)
        x, y = ({k: RND.randint(1, 60) if n else 1 for k in RND.sample(keys, RND.randint(1, 50))} for _ in range(2))
        got = near_dedup.probability_jaccard(*weighted(x), *weighted(y))
        assert got == pytest.approx(brute_probability_jaccard(x, y), abs=1e-9)
        assert got == pytest.approx(near_dedup.probability_jaccard(*weighted({k: 3 * v for k, v in x.items()}), *weighted(y)), abs=1e-9)
        if not n:
            assert got == pytest.approx(len(set(x) & set(y)) / len(set(x) | set(y)))


def test_signature_estimates_probability_jaccard():
    """Slots agree as often as the weighted similarity says, and pairs over the threshold share a band."""
    for most in (1, 60):
        found = both = 0
        for n in range(30):
            x = {int(k): RND.randint(1, most) for k in near_dedup.mixed(np.arange(n * 1000, n * 1000 + 120, dtype=np.uint64))}
            y = {k: v for k, v in x.items() if RND.random() < 0.93} | {int(k): RND.randint(1, most) for k in near_dedup.mixed(np.arange(n * 1000 + 500, n * 1000 + 506, dtype=np.uint64))}
            (a, u), (b, v) = weighted(x), weighted(y)
            parts, owner = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            sig = near_dedup.signatures(parts, np.concatenate([u, v]), owner, 2, 2048)
            want = brute_probability_jaccard(x, y)
            assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.06)
            if want >= 0.8:
                both += 1
                h = near_dedup.band_hashes(near_dedup.signatures(parts, np.concatenate([u, v]), owner, 2, 96), 24, 4)
                found += bool((h[0] == h[1]).any())
        assert both >= 5 and found >= 0.9 * both


def test_near_dedup_by_weights(spark):
    """A long refrain in both texts beside other verses: unlike sets, but most of the mass is the same."""
    texts = []
    for n in range(8):
        refrain = [f"r{n}x{k}" for k in range(30)]
        for side in "ab":
            texts.append(" ".join(refrain * 40 + [f"{side}{n}x{k}" for k in range(25)]))
    assert brute_classes(texts) == list(range(16))
    r = near_dedup.report(frame(spark, texts)).toPandas()
    assert dict(zip(r.doc_id, r.class_id)) == {i: i - i % 2 for i in range(16)}


# 10
def test_byte_bpe(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in byte_bpe.digest(frame(spark, texts), path).collect():
        t = texts[r["doc_id"]] or ""
        ids = lib.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), t
    d = frame(spark, texts).withColumn("ids", F.lit(1))
    e, name = byte_bpe.encode(d, path)
    back, out = byte_bpe.decode(e, path, ids=name)
    assert all(bytes(r[out]) == (r["text"] or "").encode() for r in back.collect())


def test_byte_bpe_long_piece():
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})
    for t in ("".join(RND.choice("abcdeth") for _ in range(200_000)), "a" * 50_001, "ab" * 3000 + "é" * 999):
        assert codec.encode(t) == lib.encode_ordinary(t)


def test_byte_bpe_of_any_characters():
    codec = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), 300)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})
    made = ["".join(chr(RND.choice([RND.randrange(32, 127), RND.randrange(0, 0x300), RND.randrange(0, 0x500), 97, 116, 104, 101, 32, 32, 10])) for _ in range(RND.randrange(80))) for _ in range(1500)]
    assert [x.tolist() for x in codec.encode_all(made)] == lib.encode_ordinary_batch(made)


def test_bound_of_counted_pairs_loses_no_link(spark):
    """Pairs with tails of their own and repeated passages: who reaches 0.8 by sets or by counts also passes the filter of the join."""
    rng = np.random.default_rng(5)
    shapes = []
    for key in range(60):
        if key % 20 == 0:
            core, often = rng.choice(1 << 40, 12, replace=False).astype(np.uint64) << np.uint64(20), rng.integers(10, 14, 12)
        own = rng.choice(1 << 62, rng.integers(0, 60), replace=False).astype(np.uint64)
        have = rng.integers(11, 13)
        grams = np.concatenate([core[:have], own])
        counts = np.concatenate([often[:have] * rng.integers(1, 4), np.ones(len(own), np.int64)])
        order = np.argsort(grams)
        bits = np.bincount((grams >> np.uint64(20)).astype(np.int64) % (64 * near_dedup.PARITY), minlength=64 * near_dedup.PARITY) & 1
        shapes.append((key, grams[order], counts[order], np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()))
    parities = [f"p{k}" for k in range(near_dedup.PARITY)]
    rows = spark.createDataFrame([(k, len(g), int(c.sum()), *p) for k, g, c, p in shapes], ["key", "n", "total", *parities])
    left, right = (rows.select(*(F.col(c).alias(x + c) for c in rows.columns)) for x in ("a_", "b_"))
    passed = {tuple(r) for r in left.join(right, (F.col("a_key") < F.col("b_key")) & near_dedup.may_match("a_", "b_", 0.8)).select("a_key", "b_key").collect()}
    linked, pairs = set(), 0
    for i, u, cu, _ in shapes:
        for j, v, cv, _ in shapes[i + 1 :]:
            pairs += 1
            common = len(np.intersect1d(u, v))
            if near_dedup.probability_jaccard(u, cu, v, cv) >= 0.8 or common >= 0.8 * (len(u) + len(v) - common):
                linked.add((i, j))
    assert linked and linked <= passed and len(passed) < pairs / 2
