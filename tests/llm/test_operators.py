"""Every operator against brute force, exact round trips, and the cases their docstrings define."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from slopecast.llm import caps, chat, decontaminate, idfiles, kernel, langid, lines, minhash, packing, quality, urls
from slopecast.llm.components import components
from slopecast.llm.queries import vocabulary
from slopecast.llm.tokens import Encoder
from slopecast.session import scratch_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
DOCS = "doc_id long, text string, score double, component_id string, key string, n_removed string, line string, word string"
ODD = ["", None, "   ", "\n", "a\n\nb", "“q” — z", "don't  stop", " x", "a\u00a0b", "x\u3000 y", "<|endoftext|> x", "a\x1cb", "ÀÉ×ß 12'S"]


def table(spark, rows):
    """(doc_id, text) rows beside columns whose names clash with what operators add."""
    return spark.createDataFrame([(i, t, 0.5, "c", "k", "r", "l", "w") for i, t in rows], DOCS)


def words(rng, n, vocabulary_size=400):
    return " ".join(f"w{rng.randrange(vocabulary_size)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 60)) for _ in range(60)]
    for b in base[:20]:
        w = b.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            base.append(" ".join(w))
    return list(enumerate([*base, base[0], base[0], "", None, "one", "one", "ONE", "a b", "A  b", words(rng, 30_000, 50_000)]))


def groups(sets, percent=80):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


# --- helpers


def test_hashes_do_not_depend_on_the_batch():
    texts = ["the cat sat on the mat", "cat the", "x " * 500]
    alone = [kernel.hashed_words(*list(kernel.text_chunks(pa.array([t])))[0][2:], kernel.NOT_SPACE)[0] for t in texts]
    data, off = list(kernel.text_chunks(pa.array(texts)))[0][2:]
    h, rows, _, _ = kernel.hashed_words(data, off, kernel.NOT_SPACE)
    for i, a in enumerate(alone):
        assert (h[rows == i] == a).all()
    g, at = minhash.shingle_sets(data, off, 2)
    assert set(minhash.shingle_sets(*list(kernel.text_chunks(pa.array([texts[0]])))[0][2:], 2)[0]) == set(g[at[0] : at[1]])


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_ids_are_the_library_s(name):
    enc, rng = Encoder(vocabulary(name)), random.Random(3)
    alpha = [*"abcXYZ'smtdrevl  \n..,!09é'×ßÀ<|", "'s", "'re", "'ll", " '", "“", "ñ", "  ", "<|endoftext|>", "漢字"]
    texts = [*ODD, *["".join(rng.choice(alpha) for _ in range(rng.randint(0, 40))) for _ in range(3000)], "word " * 40_000]
    for (_, ids), t in zip(enc.encode_column(pa.array(texts)), texts, strict=True):
        assert ids.tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids


def test_ids_stay_right_when_memory_is_full(monkeypatch):
    from slopecast.llm import tokens

    monkeypatch.setattr(tokens, "MAX_PIECES", 20)
    enc, rng = Encoder(vocabulary(BYTE)), random.Random(4)
    for _ in range(5):
        texts = [words(rng, 30) for _ in range(5)]
        for (_, ids), t in zip(enc.encode_column(pa.array(texts)), texts, strict=True):
            assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    links += [(5, 5), (0, 1), (1, 0), (None, 3)]
    want = groups({n: {("e", min(a, b), max(a, b)) for a, b in links if a is not None and n in (a, b)} for n in {x for p in links for x in p if x is not None}}, 0)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {n: n for n in want}
    for _ in range(300):
        for a, b in links:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    assert got == {n: up[n] for n in up if any(n in p and p[0] != p[1] and p[0] is not None for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 language identification


def test_suffix_automaton_holds_exactly_the_substrings():
    rng = random.Random(2)
    text = [rng.randrange(3) for _ in range(60)]
    t = langid.suffix_automaton(text, 3)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for n in range(1, 7):
        for s in itertools.product(range(3), repeat=n):
            state = 0
            for c in s:
                state = t[state, c]
                if not state:
                    break
            assert bool(state) == (s in inside)


def test_cross_parsing_matches_brute_force(spark):
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = {"xx": [make("abcde ", 150) for _ in range(9)], "yy": [make("cdefg ", 150) for _ in range(9)]}
    model = tuple((k, tuple(v)) for k, v in texts.items())
    p = langid.Parser(model)

    def phrases(parts, s):
        count, i = 0, 0
        while i < len(s):
            j = i + 1
            while j < len(s) and any(s[i : j + 1] in x for x in parts):
                j += 1
            count, i = count + 1, j
        return count

    fold = lambda s: " ".join(s.split(" ")) if "  " not in s else fold(s.replace("  ", " "))
    tests = [make(rng.choice(["abcde ", "cdefg "]), rng.randint(1, 300)) for _ in range(40)]
    tests = [t for t in tests if t.strip()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, t in enumerate(tests):
        cost = {k: phrases([fold(x) for x in v], fold(t)) * price for (k, v), price in zip(texts.items(), p.price, strict=True)}
        best = min(cost, key=lambda k: (cost[k], k))
        assert got[i].lang_pred == best
        other = max(cost, key=lambda k: (cost[k], k))
        assert math.isclose(got[i].score, 1 - cost[best] / cost[other] if best != other else 0, abs_tol=1e-9)


def test_languages_are_told_apart_and_edges(spark):
    rng = random.Random(8)
    parts = {"de": ["ung", "sch", "ein", "keit"], "fr": ["eau", "tion", "ez", "oi"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(k, rng.randint(5, 300)), k) for i, k in enumerate(["de", "fr"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "de"), (901, "x", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    odd = [(1, None), (2, ""), (3, "12 !?"), (4, "漢字"), (4, "漢字"), (None, "schein"), (6, make("fr", 40_000))]
    got = langid.identify(table(spark, odd), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (6, "fr")]
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.identify(table(spark, odd), langid.learn(docs.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(table(spark, []), model).count() == 0


# --- 2 packing


def test_differencing_balances():
    rng = random.Random(9)
    for k in (1, 2, 5, 40):
        sizes = [rng.randint(1, 500) for _ in range(300)]
        dealt = packing.difference(sizes, k)
        assert sorted(i for _, g in dealt for i in g) == list(range(300)) and len(dealt) <= k
        assert all(t == sum(sizes[i] for i in g) for t, g in dealt)
        assert dealt[0][0] - dealt[-1][0] <= (max(sizes) if k == 40 else 20)
    assert packing.difference([], 3) == []
    assert all(sum([7, 7, 7][i] for i in g) <= 10 for g in packing.windows_of([7, 7, 7], 10))


def test_packing_round_trip(spark, corpus):
    rows = [*corpus, (None, "no id"), (3, corpus[3][1])]
    capacity = 64
    got = packing.pack(table(spark, rows), vocabulary(WORD), capacity=capacity, piece=16, windows=8).collect()
    tok = Encoder(vocabulary(WORD)).tok
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    for i, copies in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        ids = copies[0]
        expect = sorted([(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n, _, _ in pieces])
        assert pieces == expect and sum(p[1] for p in pieces) == len(ids) * len(copies)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= capacity
    assert packing.pack(table(spark, []), vocabulary(WORD)).count() == 0


# --- 3 token files


def test_token_files_round_trip(spark, corpus):
    rows = [*corpus, (None, "no id"), (3, corpus[3][1]), *[(1000 + i, t) for i, t in enumerate(ODD)]]
    files = idfiles.write_ids(table(spark, rows), scratch_path(spark, "ids"), vocabulary(BYTE))
    tok = Encoder(vocabulary(BYTE)).tok
    got = idfiles.read_ids(files).orderBy("start").collect()
    assert len(got) == len(rows)
    start, texts = 0, {}
    for i, t in rows:
        texts[i] = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    for r in got:
        ids = texts[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert idfiles.fetch(files, [5, 1001]) == {5: texts[5].tolist(), 1001: texts[1001].tolist()}
    other = idfiles.IdFiles(files.folder, b"another dictionary", files.shards)
    with pytest.raises(Exception, match="another dictionary"):
        idfiles.read_ids(other).count()
    empty = idfiles.write_ids(table(spark, []), scratch_path(spark, "ids"), vocabulary(BYTE))
    assert idfiles.read_ids(empty).count() == 0


# --- 4 MinHash


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_brute_force(spark, corpus, n):
    rows = [*corpus, (None, corpus[0][1])]
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows).repartition(5), n, 80).collect()}
    sets = {i: minhash._words(t, n) for i, t in rows if i is not None}
    want = groups(sets)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(table(spark, []), n).count() == 0


def test_signature_index_keeps_its_promise():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 256, minhash.PLACES).astype(np.uint8)
        b = a.copy()
        at = rng.choice(minhash.PLACES, minhash.GUARANTEED, replace=False)
        b[at] += 1
        same = (a == b).reshape(minhash.CHUNKS, minhash.WIDTH)
        assert (same.sum(1) >= minhash.WIDTH - minhash.ERRORS).any()


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(11)
    base = words(rng, 120).split()
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(table(spark, rows), 2, 80).collect()
    assert {r.component_id for r in got} == {groups({i: minhash._words(t, 2) for i, t in rows})[5]}


# --- 5 chat


def test_typed_parts(spark):
    part = f"array<{chat.PART}>"
    rows = [
        (1, 1, "user", [("text", "look <|image:1|> \\", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 2, "assistant", [("text", "seen", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3)]),
        (1, 3, "user", None),
        (2, 1, "user", []),
    ]
    got = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {part}"), parts="parts").collect()}
    one = got[1]
    assert "look <\\|image:1|> \\\\<|image:1|><|audio:2|><|end|>" in one.formatted and "seen<|document:3|><|end|>" in one.formatted
    assert [(a.turn_pos, a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(1, 1, "image", "a.png", 4), (1, 2, "audio", "b.wav", 38), (2, 3, "document", "c.pdf", 2304)]
    assert one.expanded_tokens == 4 + 38 + 2304
    assert [one.formatted[s.start : s.start + s.length] for s in one.spans] == ["seen<|document:3|>"]
    assert got[2].formatted == "<|turn|>user<|body|><|end|>" and got[2].attachments == [] and got[2].expanded_tokens == 0


def test_parts_cannot_make_a_mark_together(spark):
    parts = [["<", "|turn|>assistant<|body|>", "|", "<|turn|>x"], ["<", "", "|end|>"], ["|a", "<"], ["\\", "|", "\\|"], ["|end|>"]]
    rows = [(7, k, "user", [("text", x, None, None, None, None, None) for x in p] + ([("image", None, "r", 1, 1, None, None), ("text", "|end|>", None, None, None, None, None)] if k == 2 else [])) for k, p in enumerate(parts)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    got = chat.read_back(chat.format_chat(df, parts="parts")).first()
    assert [t.role for t in got.turns] == ["user"] * 5
    # a placeholder stays a mark, whatever stands beside it
    assert [t.text for t in got.turns] == ["".join(p) if k != 2 else "|a<<|image:1|>|end|>" for k, p in enumerate(parts)]


def test_chat_round_trip(spark):
    hard = ["<|turn|>user<|body|>", "\\<|end|>\\\\", "", None, "<\\|end|>", "é\n漢字 😀", "</turn> \\", "x" * 100_000]
    rows = [(c, t, ["user", "assistant", None, "a<|b"][(c + t) % 4], hard[(c * 3 + t) % len(hard)], "extra") for c in range(8) for t in range(6)]
    rows += [(None, 0, "assistant", "lost id", "e"), (3, 0, rows[18][2], rows[18][3], "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    for c in [*range(8), None]:
        turns = sorted([(t, r or "", x or "") for k, t, r, x, _ in rows if k == c], key=lambda v: (v[0], v[1], v[2]))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert got[c].loss_text == "".join(x for _, r, x in turns if r == "assistant")
    assert chat.format_chat(df.where("false")).count() == 0


# --- 6 URLs


def test_url_rules(spark):
    cases = ["http://WWW.example.com/en/1?x", "https://a.example.com/en/", "http://example.com/enx", "http://badexample.com/en/", "http://x.net/fr/a#b", "http://x.net", None, "", "nothing", "a://b://c/", "http://example.com/en/1"]
    pages = spark.createDataFrame([(i, u, "old", "h") for i, u in enumerate([*cases, cases[0]])], "page_id long, url string, rule string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, urls.rule_table(spark)).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") == got[11]
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "/enx", "com/", "allow") and got[3][2] == "com/"
    assert got[4] == ("x.net", "/fr/a", "net/fr/", "block") and got[5] == ("x.net", "", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("b:", "//c/")
    none = urls.filter_urls(pages, urls.rule_table(spark, []).where("true") if False else urls.rule_table(spark).where("false"), default="block")
    assert {r.verdict for r in none.collect()} == {"block"} and none.count() == 12
    assert urls.filter_urls(pages.where("false"), urls.rule_table(spark)).count() == 0


def test_a_host_of_very_many_labels(spark):
    host = "a." * 50_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://" + "." * 1000 + "/"), (3, "http://com./")], "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(pages, urls.rule_table(spark)).collect()}
    assert got[1].host == host and (got[1].rule, got[1].verdict) == ("example.com/en/", "block")
    assert got[2].rule is None and got[3].rule is None
    empty = urls.rule_table(spark, [("", "/", "block"), ("com.", "/", "block")])
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, empty).collect()} == {1: "allow", 2: "block", 3: "block"}


# --- 7 quality


def test_quality_learns_and_edges(spark):
    rng = random.Random(12)
    good = [words(rng, rng.randint(5, 80)) for _ in range(150)]
    bad = [" ".join(f"{w}%%%" if rng.random() < 0.5 else f"| {w}" for w in words(rng, rng.randint(5, 80)).split()) for _ in range(60)]
    rows = [*[(t, 1) for t in good], *[(t, 0) for t in bad]]
    rng.shuffle(rows)
    train = spark.createDataFrame([(i, t) for i, (t, _) in enumerate([*rows[:150], (None, 1), ("x", None)])] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate([*rows[:150], (None, 1), ("x", None)])] + [(None, 0), (9999, 1), (3, 7)], "doc_id long, label int")
    model = quality.fit(train, labels)
    test = table(spark, [*[(i, t) for i, (t, _) in enumerate(rows[150:])], (500, None), (501, ""), (None, "a"), (502, "b " * 200_000)])
    got = {r.doc_id: r.score for r in quality.score(test, model).collect()}
    assert sum((got[i] >= 0.7) == bool(y) for i, (_, y) in enumerate(rows[150:])) >= 58
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    one = quality.fit(train, labels.where("label = 1"))
    assert {r.score > 0.99 for r in quality.score(test, one).collect()} == {True}
    assert quality.score(test, quality.fit(train, labels.where("false"))).first().score == 0.5
    assert quality.score(table(spark, []), model).count() == 0


def plain_features(text, bits):
    """The feature numbers of a text, token by token; only the hash of a token is the library's."""
    mask, out = (1 << 64) - 1, set()

    def mixed(x):
        return int(kernel.mix(np.array([x & mask], np.uint64))[0]) >> (64 - bits)

    def kind(t, before):
        if t == before:
            return 6
        if not (t[0].isalnum() or ord(t[0]) >= 128):
            return 4 if len(t) == 1 else 5
        if t[0] in "0123456789":
            return 3
        capitals, size = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t), len(t.encode())
        return 0 if not capitals else 2 if capitals == size and size > 1 else 1

    tokens = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff \t\n\r\x0b\x0c]+", text or "")
    hashes = [int(kernel.span_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t.encode())]))[0]) for t in tokens]
    kinds = [kind(t, tokens[i - 1] if i else None) for i, t in enumerate(tokens)]
    for i, h in enumerate(hashes):
        out.add(mixed(h + 1))
        if i + 1 < len(hashes):
            out.add(mixed(h * kernel.BASE + hashes[i + 1]))
        if i + 2 < len(hashes):
            out.add(mixed((kinds[i] * 7 + kinds[i + 1]) * 7 + kinds[i + 2] + (1 << 40)))
    return out


def test_quality_scores_match_brute_force(spark):
    rng = random.Random(21)
    tokens = ["alpha", "Beta", "GAMMA", "é", "12", "...", "!", "a1", "x,y", "(", "I", "naïve", "--", "漢字"]
    docs = [(i, " ".join(rng.choice(tokens[: 9 if i % 2 else 14]) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    y = {i: int(i % 2 == 1) for i, _ in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame(list(y.items()), "doc_id long, label int"), n=1 << 20)  # so many places that every document is drawn
    count = {0: {}, 1: {}}
    for i, t in docs:
        for f in plain_features(t, quality.BITS):
            count[y[i]][f] = count[y[i]].get(f, 0) + 1
    total = {k: (1 << quality.BITS) + sum(v.values()) for k, v in count.items()}
    ratio = lambda f: math.log((1 + count[1].get(f, 0)) / total[1] / ((1 + count[0].get(f, 0)) / total[0]))
    seen = sorted({f for v in count.values() for f in v})
    assert np.allclose(model.squares[seen], [ratio(f) ** 2 for f in seen], rtol=1e-5)
    got = {r.doc_id: r.score for r in quality.score(df.unionByName(spark.createDataFrame([(900, None), (901, "")], df.schema)), model).collect()}
    for i, t in [*docs, (900, None), (901, "")]:
        fs = sorted(plain_features(t, quality.BITS))
        margin = (sum(float(model.weights[f]) for f in fs) + model.bias) / math.sqrt(sum(float(model.squares[f]) for f in fs) + 1)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-5)
    assert sum((got[i] > 0.5) == bool(y[i]) for i in y) >= 70


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    sets = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    scale = rng.normal(size=12)
    w, bias = quality.dual_descent(sets, y, scale, 1.0, 3000)
    norm = [np.sqrt((scale[s] ** 2).sum() + 1) for s in sets]
    x = np.zeros((40, 13))
    for i, s in enumerate(sets):
        x[i, s], x[i, 12] = scale[s] / norm[i], 1 / norm[i]
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    best = loss(np.append(w, bias))
    for _ in range(2000):
        assert loss(np.append(w, bias) + rng.normal(scale=rng.choice([0.3, 0.03, 0.003]), size=13)) >= best - 2e-3


# --- 8 vectors


def test_list_decoding_finds_exactly_the_exceeding_directions():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, no = caps.decode(x, 1, 3, 5, 0.5)
    rotation, parts = caps._code(12, 1, 3, 5)
    directions = np.stack([np.concatenate([p[:, w] for p, w in zip(parts, ws, strict=True)]) for ws in itertools.product(range(5), repeat=3)])
    inner = x @ rotation @ directions.T
    want = {(i, d) for i in range(30) for d in range(125) if inner[i, d] > 0.5 or d == inner[i].argmax()}
    assert set(zip(row.tolist(), no.tolist(), strict=True)) == want
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(caps, "MEMBERS", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    vecs = [(c + rng.normal(scale=0.06, size=16)).tolist() for c in centres for _ in range(6)] + [(centres[0] + rng.normal(scale=0.03, size=16)).tolist() for _ in range(60)]
    rows = [(i, v, i % 2, "x") for i, v in enumerate(vecs)]
    rows += [(500, vecs[0], 0, "x"), (501, vecs[0], 0, "x"), (502, None, 0, "x"), (503, [], 0, "x"), (504, [0.0] * 16, 0, "x"), (505, [1.0, None], 0, "x"), (506, [float("nan")] * 2, 1, "x"), (507, vecs[0], None, "x"), (508, [1.0, 2.0], 1, "x"), (509, [2.0, 4.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: r for r in caps.near_vectors(df).collect()}
    good = {i: (np.array(v), y) for i, v, y, _ in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = {i: set() for i in got}
    for a, b in itertools.combinations(good, 2):
        (u, p), (v, q) = good[a], good[b]
        if p == q and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
            near[a].add(b), near[b].add(a)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * sum(map(len, near.values())) <= found <= sum(map(len, near.values()))
    for i, r in got.items():
        assert r.n_links <= len(near[i]) and r.kept == (r.component_id == i) and (bool(near[i]) or r.component_id == i)
    assert got[501].component_id == got[500].component_id == 0 and got[509].component_id == 508
    assert caps.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [2, 3, 8, 16, 32, 64, 256, 1024])
def test_filters_are_few_and_recall_is_high_in_any_dimension(dim):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((400, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * side
    shared, n = np.zeros(400, bool), 0
    for t in range(caps.TABLES):
        a, b = (set(zip(*map(np.ndarray.tolist, caps.decode(z, t, threshold=caps.threshold_of(dim))), strict=True)) for z in (x, y))
        n += len(a)
        for i, _ in a & b:
            shared[i] = True
    assert caps.TABLES <= n / 400 <= 50 and shared.mean() >= 0.9


def test_dimensions_that_are_equal_modulo_a_power_of_two_do_not_meet(spark):
    rows = [(i, [1.0, 2.0, float(i)] + [0.0] * (4096 * (i % 2)), 0) for i in range(8)]
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 8


# --- 1 language, many letters


def test_rare_letters_are_told_apart(spark):
    """Two languages whose letters are all rarer than the 120 most frequent ones of the samples."""
    rng = random.Random(21)
    spell = lambda first, n, size: "".join(chr(first + rng.randrange(size)) for _ in range(n))
    common = "".join(chr(0x4E00 + i) for i in range(150)) * 20
    one, two = (tuple(spell(first, 200, 80) for _ in range(3)) for first in (0x6000, 0x7000))
    model = (("common", (common,)), ("one", one), ("two", two))
    p = langid.Parser(model)
    letters = {c for _, parts in model for c in "".join(parts)}
    assert len({tuple(p.fold(np.array([ord(c)], np.uint32))) for c in letters}) == len(letters) > 250
    texts = [(0, spell(0x6000, 300, 80)), (1, spell(0x7000, 300, 80)), (2, one[0][20:90] + ", " + one[1][:50]), (3, two[2] * 9), (4, common[:90])]
    got = {r.doc_id: r.lang_pred for r in langid.identify(table(spark, texts), model).collect()}
    assert got == {0: "one", 1: "two", 2: "one", 3: "two", 4: "common"}


# --- 9 lines


@pytest.mark.parametrize(("crowd", "count_bits"), [(1000, 20), (0, 6), (3, 8)])
def test_lines_match_brute_force(spark, monkeypatch, crowd, count_bits):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "COUNT_BITS", count_bits)
    rng = random.Random(13)
    pool = [words(rng, rng.randint(1, 30), 60).split() for _ in range(40)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(1, 8)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            out.append(" ".join(w))
        docs.append((i, "\n".join(out)))
    docs += [(100, ""), (101, None), (102, "\n\n"), (103, docs[0][1]), (103, docs[0][1]), (None, docs[1][1]), (104, words(rng, 20_000, 30_000))]
    before, want = [], {}
    for i, t in sorted({d for d in docs if d[0] is not None}, key=lambda d: d[0]):
        want[i] = []
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(line.lower().split())
            if len(w) >= lines.MIN_WORDS:
                if any(100 * len(w & p) >= 80 * len(w | p) for p in before):
                    want[i].append(k)
                before.append(w)
    got = lines.dedup_lines(table(spark, docs).repartition(4)).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        if r.doc_id is None:
            assert r.text == docs[1][1] and r.n_removed == 0
            continue
        assert r.removed == want[r.doc_id] and r.n_removed == len(r.removed)
        t = text[r.doc_id]
        assert r.text == (t if not r.removed else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in r.removed))
    assert lines.dedup_lines(table(spark, [])).count() == 0


def test_copies_of_short_lines_are_removed(spark):
    """No line is too short to lose its copies, whether it has few words or few distinct ones; blank lines stay."""
    docs = [(0, "x y x y x\nred\nred green\n\none two three four"), (1, "Y x y x y\nRed\nred blue\n\nfive four three two one"), (2, "green red\n \n\nred\nblue red green")]
    got = {r.doc_id: (r.removed, r.text) for r in lines.dedup_lines(table(spark, docs)).collect()}
    assert got[0] == ([], docs[0][1])
    assert got[1] == ([0, 1, 4], "red blue\n")
    assert got[2] == ([0, 3], " \n\nblue red green")


# --- 10 decontamination


def test_windows_match_brute_force(spark):
    rng = random.Random(14)
    items = [(i, words(rng, rng.choice([0, 1, 2, 4, 9, 10, 11, 25]), 90)) for i in range(25)] + [(30, None), (31, "ÀB-1 x"), (3, "same id other words here")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randint(0, 60), 5000).split()
        if i % 2:
            src = (rng.choice(items)[1] or "").upper().split()
            at = rng.randint(0, len(w))
            cut = rng.randint(0, max(0, len(src) - 10))
            w[at:at] = src[cut : cut + rng.choice([9, 10, 25])]
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "Àb 1? X"), (103, docs[1][1]), (103, docs[1][1]), (None, docs[3][1]), (104, words(rng, 20_000, 30_000))]
    split = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in (t or "")).translate({i: " " for i in range(128) if not chr(i).isalnum()}).split(" ") if w]
    got = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    windows = {(str(i), tuple(w[k : k + 10])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - 9))}
    by_id = dict(docs)
    for r in got:
        w = split(by_id[r.doc_id])
        hit, found = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))
    empty = decontaminate.decontaminate(table(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and empty.count() == len(docs)
    assert decontaminate.decontaminate(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
