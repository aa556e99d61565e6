"""Fill-in-the-middle, the streaming BPE transducer and the divergence audit against brute force and the library."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemograph.llm import fill_in_middle, source_divergence, streaming_bpe

RND = random.Random(5)
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "a", "<", "<P>", "x <S> y", "plain text " * 50, "日本語テキスト" * 20, "<<P" * 9, "\U0001f600 é", *("".join(RND.choice("ab <PSM>é\n") for _ in range(RND.randrange(90))) for _ in range(60))]


def brute_middle(doc_id, text):
    t = text or ""
    h = hashlib.sha256(b"1:" + str("" if doc_id is None else doc_id).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = min(h1 % (len(t) + 1), h2 % (len(t) + 1)), max(h1 % (len(t) + 1), h2 % (len(t) + 1))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", [1, 2, 7, 8192])
def test_fill_in_middle(spark, units):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for i, t in rows:
        form, a, m, out = brute_middle(i, t)
        want.append((i, len(t or ""), form, a, m, sha(out), sha(t or "")))
    got = [tuple(r) for r in fill_in_middle.digests(docs, units=units).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = [(r["doc_id"], r["output"]) for r in fill_in_middle.outputs(docs, units=units).collect()]
    assert sorted(whole, key=str) == sorted(((i, brute_middle(i, t)[3]) for i, t in rows), key=str)


def test_pieces_are_bounded_and_in_order(spark):
    docs = spark.createDataFrame([(n, "x" * 1000) for n in range(20)], "doc_id long, text string")
    by_row = collections.defaultdict(list)
    for r in fill_in_middle.pieces(docs, units=64).collect():
        by_row[r["row"]].append((r["place"], bytes(r["piece"])))
    assert len(by_row) == 20
    for own in by_row.values():
        assert own == sorted(own) and max(len(p) for _, p in own) <= 64
        assert all(a + len(p) == b for (a, p), (b, _) in zip(own, own[1:]))


def test_streaming_bpe_as_the_library(spark):
    library = Tokenizer.from_file(WORDS_FILE)
    odd = ["ha" * 4000, "=" * 3000 + "!" * 3000, "".join(RND.choice("aehlnot") for _ in range(9000)), "é" * 3000, "ΑΣ ΣΑΣ İi", "<|endoftext|>a<|startoftext|>b <|END|>", "don't WON'T 'Re 12 a1b2", "é É ẞ", "\x00\x07 a\x7fb", "tab\tand\r\nline wide\x85"]
    texts = [*TEXTS, *odd, *("".join(RND.choice("ab thxé ,.'sSΣσςİ<|endoftext|>1日本\n\t‍~=-") for _ in range(200)) for _ in range(200))]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in streaming_bpe.digest(docs, WORDS_FILE).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), texts[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded, name = streaming_bpe.encode(docs, WORDS_FILE)
    back, text = streaming_bpe.decode(coded, WORDS_FILE, ids=name)
    assert all(r[text] == "aehl ö 日 " for r in streaming_bpe.decode(streaming_bpe.encode(spark.createDataFrame([("AEHL Ö\t日",)], "text string"), WORDS_FILE)[0], WORDS_FILE)[0].select(text).collect())
    assert back.count() == len(texts)


def test_transducer_is_final_and_bounded():
    """Ids come out before the word ends, are never taken back, and the window doesn't grow with the word."""
    merges = streaming_bpe.MergeList(WORDS_FILE)
    assert 32 <= merges.lookahead < 2000
    for letters in ("aehlnotrsi", "a", "ha", "!?.-=*#~"):
        for _ in range(30):
            word = "".join(RND.choice(letters) for _ in range(RND.randrange(1, 4000)))
            run, out, held, at = streaming_bpe.Transducer(merges, merges.lookahead + 2), [], 0, 0
            while at < len(word):
                step = RND.randrange(1, 60)
                out += list(run.push(word[at : at + step]))
                at += step
                held = max(held, len(run.held))
            assert held <= run.window + 60
            assert out + run.end() == merges.merged([*map(merges.letter.__getitem__, word[:-1]), merges.last[word[-1]]])


def test_lookahead_of_a_small_list(tmp_path):
    """a+b, c+d, ab+cd: the token ab waits for cd; a chain of right sides is longer than one token."""
    import json

    vocab = {c: n for n, c in enumerate(["a", "b", "c", "d", "a</w>", "b</w>", "c</w>", "d</w>", "cd", "bcd", "abcd"])}
    model = {"added_tokens": [], "model": {"vocab": vocab, "merges": [["c", "d"], ["b", "cd"], ["a", "bcd"]], "end_of_word_suffix": "</w>"}}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(model))
    assert streaming_bpe.MergeList(str(path)).lookahead == 3
    model["model"]["merges"].reverse()
    path.write_text(json.dumps(model))
    with pytest.raises(ValueError):
        streaming_bpe.MergeList(str(path))


def test_decoder_waits_for_whole_characters():
    merges = streaming_bpe.MergeList(WORDS_FILE)
    ids = np.frombuffer(b"".join(streaming_bpe.Codec(WORDS_FILE).encode("日本 ö \U0001f9ff".encode())), "<u4").tolist()
    decoder = streaming_bpe.Decoder(merges, shown=False)
    parts = [decoder.push([i]) for i in ids]
    assert "".join(parts) + decoder.end() == "日本 ö \U0001f9ff " and "�" not in "".join(parts)


def brute_divergence(rows, ranks):
    """Every term of every pair, one by one."""
    count, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in ((g or "", s or "", t or "") for g, s, t in rows):
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: [count[lang, s][t] for t in kept] for g, s in groups if g == lang}
        whole = [sum(c) for c in zip(*own.values())]
        share = lambda c: [1 + 1_000_000_000 * (x + 1) // (sum(c) + len(kept)) for x in c]
        q0 = share(whole)
        p = {s: share(c) for s, c in own.items()}
        for s in own:
            pairs = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode(), o) for o in own if o != s)
            out += [(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(pairs)]
            terms = sorted((-((a - b) ** 2 // b), t.encode(), t) for t, a, b, c in zip(kept, p[s], q0, own[s]) if c and a > b)
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(terms[:ranks])]
    return sorted(out)


@pytest.mark.parametrize("postings, block", [(40, 3), (400_000, 500)])
def test_divergence(spark, postings, block):
    """One source has a third of all rows; runs spill every few texts."""
    words = ["The", "the", "of", "naïve", "Straße", "o'er", "x1y", *(f"w{c}" for c in "abcdefghijklmnop"), "日本", "É"]
    rows = [(RND.choice(["en", "de", None, "xx"]), RND.choice(["hot", "hot", "a", "b", None, "c d"]), RND.choice([None, "", " ".join(RND.choice(words) for _ in range(RND.randrange(40)))])) for _ in range(300)]
    rows += [("solo", "one", "never kept"), ("bare", "p", None), ("bare", "q", "12 34"), ("en", "empty", ""), *[("en", "big", "the " * 30_000)] * 2]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = source_divergence.report(docs, ranks=5, postings=postings, block=block).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, 5)
    empty = source_divergence.report(docs.limit(0))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0


def test_heap_opens_blocks_when_reached():
    """Equal terms of several runs are one; at most one block of each run is open."""
    runs = [[f"{c}{n}".encode() for c in "abcdef" for n in range(4)] for _ in range(3)]
    blocks = sorted((part[0], part, [1] * len(part), [2] * len(part), ["s", "t"] * len(part), [1, 5] * len(part)) for run in runs for part in (run[k : k + 5] for k in range(0, len(run), 5)))
    reached = []
    for n, got in enumerate(source_divergence.merged(reached.append(b[0]) or b for b in blocks)):
        assert got == (runs[0][n], 3, {"s": 3, "t": 15})
        assert len(reached) <= 3 * (n // 5 + 2)
    assert n == len(runs[0]) - 1
    large = source_divergence.share(source_divergence.exact([10**12]), source_divergence.exact([10**13]), 7)
    assert large.tolist() == [1 + 10**9 * (10**12 + 1) // (10**13 + 7)]


def brute_covering(rows, names, cuts, limits):
    """Sequential covering row by row: FOIL gain over all conditions, the best beginning on the pruning rows, until a rule isn't good enough."""
    import math

    most_conditions, most_rules, least_cover, precision = limits
    met = lambda r, rule: all((r[n] >= c) if way == ">=" else (r[n] < c) for n, way, c in rule)
    mass = lambda rs: (sum(r["weight"] for r in rs if r["bad"]), sum(r["weight"] for r in rs if not r["bad"]))
    found, left = [], rows
    while len(found) < most_rules:
        rule, own = [], [r for r in left if not r["prune"]]
        while len(rule) < most_conditions:
            own = [r for r in own if met(r, rule)]
            b, g = mass(own)
            if not b or not g:
                break
            now, best, gain = math.log2(b / (b + g)), None, 1e-9
            for n in names:
                for way in (">=", "<"):
                    for c in range(1, len(cuts[n]) + 1):
                        x, y = mass([r for r in own if met(r, [(n, way, c)])])
                        if x and x * (math.log2(x / (x + y)) - now) > gain + 1e-12:
                            best, gain = (n, way, c), x * (math.log2(x / (x + y)) - now)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        value = []
        for k in range(1, len(rule) + 1):
            b, g = mass([r for r in left if r["prune"] and met(r, rule[:k])])
            value.append(((b - g) / max(1, b + g), -k, b, g))
        _, k, b, g = max(value)
        rule = rule[:-k]
        if b < least_cover or b < precision * (b + g):
            break
        left = [r for r in left if not met(r, rule)]
        found.append([(n, way, cuts[n][c - 1]) for n, way, c in rule])
    return found


@pytest.mark.parametrize("seed", range(3))
def test_covering_rules_brute_force(spark, seed):
    """Two causes of bad rows and noise: the learned list is the one that plain covering finds."""
    from mnemograph.llm import quality_rules

    rnd = random.Random(seed)
    names = ["a", "b", "c"]
    rows = []
    for n in range(700):
        r = {x: rnd.randrange(6) for x in names}
        bad = (r["a"] >= 4 and r["b"] < 2) or r["c"] >= 5
        rows.append({"prune": n % 3 == 2, "bad": bad != (rnd.random() < 0.04), "weight": 1.0 + (n % 4) / 8, **r})
    learner = quality_rules.Learner.__new__(quality_rules.Learner)
    learner.names, learner.cuts = names, {x: [float(10 * k) for k in range(1, 6)] for x in names}
    learner.rows = spark.createDataFrame([tuple(r.values()) for r in rows], "prune boolean, bad boolean, weight double, a int, b int, c int")
    limits = (quality_rules.MOST_CONDITIONS, quality_rules.MOST_RULES, quality_rules.LEAST_COVER, quality_rules.PRECISION)
    got = learner.rules()
    assert got == brute_covering(rows, names, learner.cuts, limits) and len(got) >= 2
