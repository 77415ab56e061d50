"""The manifest, the spelling variants and the token counts against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from slopecast.llm import manifest, spelling, tokencounts
from slopecast.llm.queries import vocabulary

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank long, w long, word string, n long, key string"
OWN = manifest.COLUMNS
BYTE = "byte_bpe_50k.json"


def table(spark, rows):
    """Rows of the documents' columns beside columns whose names clash with what operators add."""
    return spark.createDataFrame([(*r, "t", 1, 2, "w", 3, "k") for r in rows], DOCS)


# --- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        now = out[-1]
        out.append([H(*now[i : i + 8]) for i in range(0, len(now), 8)])
    return out


def siblings(levels, i):
    for nodes in levels[:-1]:
        run = i - i % 8
        yield nodes[run:i], nodes[i + 1 : run + 8]
        i //= 8


def merkle(rows):
    """Rows of the query by definition; wholly equal rows are told apart by nothing."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = re.sub("[A-Z]", lambda m: m[0].lower(), r[4]) if hit and r[4] is not None else r[4]
            node = leaf_of((*r[:4], text))
            for left, right in path:
                node = H(*left, node, *right)
            proof = H(*(x for a, b in path for x in (*a, *b)))
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(out)


def made(df, **kw):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    m = manifest.manifest(df, "doc_id", "lang", OWN, {"text": F.translate("text", manifest.UPPER, manifest.LOWERED)}, hit, **kw)
    rows = m.proofs().select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return Counter(tuple(r) for r in rows)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(2)
    ids = [*rng.sample(range(-3000, 3000), 600), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)), -(1 << 63), (1 << 63) - 1]
    langs = ["en", None, "de", "", "é", "e", "en\u0000", "language-of-many-letters", "language-of-many-lettres"]
    rows = [(d, rng.choice(["s", None]), "en" if i < 520 else rng.choice(langs), rng.choice([1, None]), rng.choice(["Ab C", "", None, "É x", "x" * 3000])) for i, d in enumerate(ids)]
    rows += [(None, "s", "en", 1, "Null id"), (None, "t", "en", 1, "null id"), (None, None, None, None, None), rows[3], rows[3], (rows[3][0], "other", *rows[3][2:])]
    assert made(table(spark, rows)) == merkle(rows)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(1, "s", "en", 1, "One Leaf")], [(i, "s", f"l{i}", 1, "T") for i in range(9)]):
        assert made(table(spark, rows)) == merkle(rows)


def test_ranks_number_every_row_once(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, *range(-70, 70)]), rng.choice([None, 0, 1 << 40])) for _ in range(400)]
    got = manifest.ranks(spark.createDataFrame(rows, "g string, x long, y long"), ["g"], ["x", "y"]).collect()
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        order = [(r.x is not None, r.x or 0, r.y is not None, r.y or 0) for r in mine]
        assert order == sorted(order)


def test_block_width_changes_nothing(spark):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(70)]
    assert made(table(spark, rows), levels=1) == merkle(rows)


# --- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, ratio=5):
    out = {}
    for w, n in words.items():
        others = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, n, len(others), words[form] if form else None]
    result = {}
    for w, (form, n, k, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, n, k, form_n)
    return result


def counted(rows, least, damage):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


@pytest.mark.parametrize("held", [1 << 18, 1])
def test_words_match_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    rng = random.Random(6)
    alpha = [*"abcdeXYZ", "é", "ÿ", "À", "ā", "“", " ", "1", "\n", "×"]
    rows = [(rng.choice([None, i, -i]), "".join(rng.choice(alpha) for _ in range(rng.randint(0, 400)))) for i in range(200)]
    rows += [(7, None), (7, ""), (8, "abcdef " * 50_000), (9, "a" * 200_000), rows[0], rows[0]]
    df = table(spark, [(d, None, None, None, t) for d, t in rows])
    for damage in (None, 3):
        got = spelling.word_counts(df, least_letters=4, damage=damage).collect()
        assert {r.word: r.n for r in got} == counted(rows, 4, damage) and len(got) == len({r.word for r in got})


def test_variants_match_brute_force(spark):
    rng = random.Random(1)
    words = {}
    for _ in range(120):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
        words[w] = rng.choice([5, 25, 125, 125, 625, rng.randint(5, 900)])
    words |= {"a" * 500: 10, "a" * 501: 50, "ab" * 300: 9, "x" * 40: 1, "𐐷bcdef": 8, "bcdef": 8, "bcdef": 1, "straße": 2}
    df = spark.createDataFrame([*words.items(), (None, 9)], "word string, n long").selectExpr("word", "n", "word a", "n near_n", "n sig")
    got = spelling.spelling_variants(df).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants(words) and len(got) == len(words)
    assert sum(v[1] not in (k, v[0]) for k, v in variants(words).items()) > 0  # chains of forms occur
    assert spelling.spelling_variants(df.where("false")).count() == 0


def test_no_join_of_the_vocabulary_is_broadcast(spark, monkeypatch):
    """Signed words, 28 for each, were sized as the words, and half a GB of documents broke the driver."""
    plans, reused = [], spelling.reused
    monkeypatch.setattr(spelling, "reused", lambda df, name: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or reused(df, name))
    df = spark.createDataFrame([("receive", 90), ("recieve", 4), ("receves", 3), ("receve", 15), ("alone", 7)], "word string, n long")
    out = spelling.spelling_variants(df)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    joins = [x for p in plans for x in p.splitlines() if "Join" in x]
    assert len(joins) >= 5 and not any("Broadcast" in x for x in joins)
    assert {r.word: r.root for r in out.collect()} == {"receive": "receive", "recieve": "recieve", "receves": "receive", "receve": "receive", "alone": "alone"}


def test_every_near_pair_shares_a_signature():
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(300):
        w = [rng.choice("abcdefgé") for _ in range(rng.randint(1, 14))]
        kinds = [w[:1] + ["z"] + w[1:], w[1:], ["q", *w[1:]]]
        sig = spelling.signatures(pa.array(["".join(x) for x in (w, *kinds)]))
        assert all((sig[0] == s).any() for s in sig[1:])


# --- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTE))


def tokens(df, **kw):
    return Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencounts.token_counts(df, vocabulary(BYTE), **kw).collect())


def test_counts_match_the_library(spark, library):
    rng = random.Random(4)
    alpha = [*"abcXYZ'smtdrevl  \n..,!09é'×ßÀ<|", "'s", "'re", " '", "“", "ñ", "   ", "<|endoftext|>", "漢字", " ", "\n\n  ", "don't ", "  <|endoftext|>  ", "<|endof"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 1500))) for _ in range(80)]
    texts += ["a" * 5000, " " * 5000, "ab " * 3000, "漢" * 4000, "x" * 700 + " " + "y" * 3000, "", None, "a", "<|endoftext|>" * 300, "!" * 100 + " " * 900 + "b"]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3]), (4, "a" * 5000)]
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in rows)
    df = table(spark, [(d, None, None, None, t) for d, t in rows])
    # narrow overlaps: runs without a common boundary have to be widened
    assert tokens(df, chunk=256, overlap=64) == want
    assert tokens(df) == want
    assert tokens(df.where("false")) == Counter()


def test_unaligned_chunks_are_seen_and_widened(spark, library, monkeypatch):
    rounds = []
    own = tokencounts._chunks
    monkeypatch.setattr(tokencounts, "_chunks", lambda t, c, o: rounds.append((c, o)) or own(t, c, o))
    text = "word " * 300 + "z" * 1000 + " word" * 300
    df = spark.createDataFrame([(1, text), (2, "word " * 600)], "doc_id long, text string")
    want = {1: len(library.encode(text, add_special_tokens=False)), 2: len(library.encode("word " * 600, add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in tokencounts.token_counts(df, vocabulary(BYTE), chunk=400, overlap=32).collect()} == want
    assert len(rounds) > 1 and all(b[1] > a[1] for a, b in zip(rounds, rounds[1:], strict=False))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_encode_whole_texts(spark, name):
    texts = ["Hello  wörld", "", None, "many words " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(df, vocabulary(name), chunk=256, overlap=32).collect()}
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t: len(Tokenizer.from_file(vocabulary(name)).encode(t, add_special_tokens=False))
    assert got == {i: count(t or "") for i, t in enumerate(texts)}
