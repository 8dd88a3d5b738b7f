"""Source audit, decontamination and token alignment against brute force and DuckDB."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewright.llm import alignment, bpe, decontaminate, jaccard_join, packing, queries, source_audit

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def aligned_by_hand(texts):
    """Rows of the alignment from the tokens' byte ranges alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    back = {c: i for i, c in enumerate(alignment.byte_characters())}
    docs, held = [], Counter()
    for text in texts:
        full = (" " + (text or "")).encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [[bytes(back[c] for c in a.id_to_token(i)) for i in ia], [alignment.piece_bytes(b.id_to_piece(i)) for i in ib]]
        if not text or any(b"".join(p) != full for p in parts):
            docs.append(None)
            continue
        ranges = []
        for p in parts:
            ends = list(itertools.accumulate(map(len, p)))
            ranges.append(list(zip([0, *ends], ends, strict=False)))
        both = {e for _, e in ranges[0]} & {e for _, e in ranges[1]}
        owner = {}
        links, j = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            while ranges[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ib) and ranges[1][k][0] < e:
                links.append((ia[i], ib[k]))
                k += 1
        groups = []
        for ids, own in ((ia, ranges[0]), (ib, ranges[1])):
            n = 0
            for i, (_, e) in zip(ids, own, strict=True):
                owner.setdefault(n, ([], []))[ids is ib].append(str(i))
                n += e in both
        groups = [f"{','.join(x)}|{','.join(y)}" for _, (x, y) in sorted(owner.items())]
        docs.append((len(ia), len(ib), groups, links))
        held.update(set(links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for k, d in enumerate(docs):
        if d is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((k, d[0], d[1], len(d[2]), len(d[3]), sum(held[x] == most[x[0]] for x in d[3]), sum(held[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part", [1_000_000, 400])
def test_alignment(spark, tmp_path, monkeypatch, part):
    rng = random.Random(3)
    texts = ["", None, " ", "  ", "a", "a ", "<|endoftext|> x", "a▁b", "x <s> y <0x41>", "tab\tand\n new  lines \n\n  end ", "a\x1c b\x1f  c\x85 d　 e\xa0 f", "\x00 nul\x00 x", "é😀 ñ 漢字かな交じり文 🏳️", "Ａ full", "x" * 3000, "same text", "same text"]
    texts += ["".join(rng.choice("ab cé\n \t漢😀.,1'sS  \x1d") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(alignment, "PART_PAIRS", part)
    rows = sorted(map(tuple, queries.op13_token_alignment(spark, str(tmp_path)).collect()))
    assert rows == aligned_by_hand(texts)
    assert sum(r[1] == 0 for r in rows) == 3 and sum(r[3] < r[1] for r in rows) > 100


def test_alignment_forgets_its_chunks(spark, monkeypatch):
    """Small caches give the same rows."""
    aligner = alignment.Aligner(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    texts = ["some words here", "naïve œuvre", "some more words", "xx yy zz"]
    whole = [[aligner.groups[n] for n in own] for own in aligner(texts)]
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 1)
    for text, groups in zip(texts, whole, strict=True):
        (own,) = aligner([text])
        assert [aligner.groups[n] for n in own] == groups


def test_automaton_against_windows():
    """Random items over few words: hit places and named items by comparing all windows."""
    rng = random.Random(1)
    for _ in range(1500):
        size, words = rng.choice([1, 2, 3, 4]), [b"a", b"b", b"c"][: rng.choice([1, 2, 3])]
        items = [(str(i) if rng.random() < 0.9 else None, [rng.choice(words) for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 4))]
        doc = [rng.choice([*words, b"z"]) for _ in range(rng.randint(0, 14))]
        hit, named, longest = set(), set(), 0
        for name, item in items:
            k = min(size, len(item))
            for i in range(len(item) - k + 1 if item else 0):
                for j in range(len(doc) - k + 1):
                    if doc[j : j + k] == item[i : i + k]:
                        hit |= set(range(j, j + k))
                        named |= {name} - {None}
                        n = k
                        while i + n < len(item) and j + n < len(doc) and doc[j + n] == item[i + n]:
                            n += 1
                        longest = max(longest, n)
        spans, found, most = decontaminate.Automaton(items, size)(doc)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == named and most == longest
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("part", [250_000, 5])
def test_decontamination_removes_spans(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    items = spark.createDataFrame([(1, ITEM), (2, "Tiny item"), (2, "tiny ITEM"), (None, "no id here"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten twelve")], "item_id long, text string")
    texts = ["Before it, ONE two-three four five six seven eight nine ten (eleven). And after that there are enough other words to stay.", ITEM + " x", "has a Tiny, item in it and é😀 around tiny item", "no id here at all, as it seems to be", "", None, "one two three four five six seven eight nine"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert [(rows[i].n_words, rows[i].n_hit, rows[i].longest, rows[i].items) for i in range(7)] == [(23, 11, 11, ["1", "5"]), (13, 12, 12, ["1", "5"]), (11, 4, 2, ["2"]), (10, 3, 3, []), (0, 0, 0, []), (0, 0, 0, []), (9, 0, 0, [])]
    assert [texts[2][s.start : s.end] for s in rows[2].spans] == ["Tiny, item", "tiny item"]
    clean = {r.doc_id: r.text for r in decontaminate.remove(docs, items).collect()}
    assert clean == {0: "Before it, ). And after that there are enough other words to stay.", 2: "has a  in it and é😀 around ", 3: " at all, as it seems to be", 4: "", 5: None, 6: texts[6]}
    assert decontaminate.remove(docs, items).columns == docs.columns


def test_decontamination_without_items(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    (r,) = decontaminate.find(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert (r.n_words, r.n_hit, r.items, r.spans) == (2, 0, [], [])


@pytest.fixture()
def audited(spark, tmp_path):
    rng = random.Random(7)
    words = ["Haus", "baum", "BAUM", "été", "l'été", "x", "naïve", "word", "words", "wo", "漢字", "a_b", "q9q", "zz", "z"]
    rows = [(" ".join(rng.choice(words[: rng.randint(1, 15)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    rows += [("once", "fr", "s1"), ("twice", "fr", "s2"), (None, "fr", "s3"), ("", "it", "s1"), *[("same text", "en", "s1")] * 5]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("leaves", [200_000, 3])
def test_audit_against_sql(spark, audited, monkeypatch, leaves):
    monkeypatch.setattr(source_audit, "TRIE_LEAVES", leaves)
    monkeypatch.setattr(source_audit, "LEAF_ROWS", 4)
    monkeypatch.setattr(source_audit, "BLOCK_CELLS", 8)
    monkeypatch.setattr(source_audit, "HELD_PAIRS", 10)
    rows = queries.op11_source_divergence(spark, audited)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{audited}/documents.parquet/*.parquet'")
    expected = db.execute(queries.OP11_SQL)
    names = [c[0] for c in expected.description]
    assert rows.columns == names
    assert sorted(map(tuple, rows.collect())) == sorted(expected.fetchall())
    assert rows.where("lang = 'fr' and part = 'pair' and value = 0").count() == 6 and rows.where("lang = 'fr' and part = 'term'").count() == 0


def test_audit_keeps_best_ranks(spark, audited):
    docs = spark.read.parquet(f"{audited}/documents.parquet")
    best = source_audit.audit(docs, least=1, ranks=2).where("part = 'term'").collect()
    every = source_audit.audit(docs, least=1, ranks=1000).where("part = 'term' and rank <= 2").collect()
    assert sorted(map(tuple, best)) == sorted(map(tuple, every)) and max(r["rank"] for r in best) == 2


def test_trie_is_in_byte_order():
    rng, trie, counts = random.Random(2), source_audit.Trie(), Counter()
    for _ in range(3000):
        key = "".join(rng.choice("abé漢") for _ in range(rng.randint(1, 6))).encode()
        trie.leaf(key)[0] += 1
        counts[key] += 1
    assert [(k, leaf[0]) for k, leaf in trie] == sorted(counts.items()) and trie.leaves == len(counts)


def test_shares_are_exact():
    import numpy as np

    rng = random.Random(5)
    cases = [(rng.randrange(10**rng.randint(0, 14)), rng.randrange(1, 10**15)) for _ in range(2000)]
    for c, n in cases:
        n = max(n, c + 1)
        assert source_audit.shares(np.array([c], np.int64), n)[0] == 1 + 10**9 * (c + 1) // n


def test_decontamination_against_sql(spark, tmp_path):
    rng = random.Random(9)
    words = "a b c Dé 9 漢".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(20, None), (21, "b")]
    docs = [(i, re.sub(" ", lambda m: rng.choice([" ", "  ", "-", "\n"]), " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 40))) + " " + (rng.choice(items)[1] or ""))) for i in range(80)] + [(100, None), (101, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    rows = queries.op12_decontamination(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == sorted(db.execute(queries.OP12_SQL).fetchall())
    assert rows.where(F.col("contaminated")).count() > 20


def test_lines_are_the_sections_that_are_given(spark):
    """Token counts by line inside the task equal those of line sections that come as a column."""
    from platewright.llm import token_counts

    texts = ["", None, "one line", "a\nb\n\nc ñandú 😀\n", "\n\n", "x" * 700 + "\n" + "word " * 90, "tab\there\r\nand there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = token_counts.count_tokens(df.withColumn("sections", token_counts.line_sections(F.col("text"))), A_PATH, P.PATTERN)
    own = token_counts.count_tokens(df, A_PATH, P.PATTERN, sections=None)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, given.collect())) and own.columns == given.columns


def test_packing_looks_words_up_once():
    """A slice's equal words are looked up once; ids are the tokeniser's own, white space of every kind and words of other alphabets too."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    odd = ["".join(rng.choices("ab'sÀéİ日 \x1c\x1f<|endoftext|>٣\n\t\x85\xa0 .,9½", k=rng.randint(0, 14))) for _ in range(400)]
    texts = ["the same old words " * 2_000, None, "", " ", *odd]
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        serialized = f.read()
    tokens, looked = packing.WordTokens(serialized), []

    class Counted(type(tokens.words)):
        def of(self, keys):
            looked.extend(keys)
            return super().of(keys)

    tokens.words = Counted()
    whole = Tokenizer.from_str(serialized)
    assert [np.frombuffer(x, np.uint32).tolist() for x in tokens(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(looked) == len(set(looked)) and looked.count("same") == 1


@pytest.mark.parametrize("words", [1, 3, 5])
def test_shingles_hash_words_together(words, monkeypatch):
    """Sets of many texts have the sizes and common elements of the texts' own shingles; only very long words are hashed one by one."""
    rng, hashed, plain = random.Random(words), [], jaccard_join.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard_join.xxhash, "xxh3_64_intdigest", lambda word: hashed.append(word) or plain(word))
    parts = [*"abAB é\x1c\x85\t\n\v\f\r\0", "  ", "W" * 8, "w" * 9, "y" * 64, "z" * 65, "Z" * 130]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(600)] + [None, "", " ", "z" * 65 + " Ab" * 400]

    def by_hand(text):
        found = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(words, len(found))
        return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()

    sets, expected = jaccard_join.Shingler(words).sets(texts), [by_hand(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in expected] and all((s[1:] > s[:-1]).all() for s in sets)
    assert len({s.tobytes() for s in sets}) == len({frozenset(s) for s in expected})
    for i, j in zip(range(len(texts)), rng.sample(range(len(texts)), len(texts)), strict=True):
        assert len(np.intersect1d(sets[i], sets[j])) == len(expected[i] & expected[j])
    assert hashed and min(map(len, hashed)) > jaccard_join.LONG_WORD


def test_trie_finds_near_keys_in_few_steps():
    """Keys in order are found from the last one's path; every slice adds the counters of its texts."""
    steps = []

    class Key(bytes):
        def startswith(self, *args):
            steps.append(args)
            return super().startswith(*args)

    trie, keys = source_audit.Trie(), [b"a" * i + b"b" * (j % 2) for i in range(1, 200) for j in range(2)]
    for key in [*keys, *sorted(keys)]:
        trie.leaf(Key(key))[0] += 1
    assert [(k, leaf[0]) for k, leaf in trie] == [(k, 2) for k in sorted(keys)] and len(steps) < 6 * 2 * len(keys)


def test_counted_leaves_against_counts(monkeypatch):
    rng = random.Random(3)
    rows = [("".join(rng.choices("abAZ é漢\0\x1c\x85 .9", k=rng.randint(0, 12))), rng.choice(["", "en", "de"]), rng.choice(["", "s", "t"])) for _ in range(900)]
    expected = Counter()
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        expected.update((lang, t, source) for t in terms)
        expected.update((lang, t, None) for t in set(terms))
    table = pa.table({name: [r[i] for r in rows] for i, name in enumerate(("text", "lang", "source"))})
    for most in (400_000, 5):
        monkeypatch.setattr(source_audit, "TRIE_LEAVES", most)
        found = Counter()
        for batch in source_audit._counted(iter(table.to_batches(50))):
            for r in batch.to_pylist():
                assert len(set(r["sources"])) == len(r["sources"])
                found[r["lang"], r["term"], None] += r["docs"]
                found.update({(r["lang"], r["term"], s): n for s, n in zip(r["sources"], r["counts"], strict=True)})
        assert found == expected


def test_bpe_cuts_plain_chunks_together(monkeypatch):
    """Only chunks of other white space are cut one by one; ids are those of the library."""
    import tiktoken

    ranks, alone, plain = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), [], bpe.Codec.split
    monkeypatch.setattr(bpe.Codec, "split", lambda self, chunk: alone.append(chunk) or plain(self, chunk))
    rng = random.Random(6)
    texts = ["".join(rng.choices([*"ab'sÀé日 \x1c\x85\xa0\n\t\r.,!9½ª", "  ", " \n", "'re"], k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", " ", "\n", "it's 12 plain words, twice: plain words!"]
    library = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, P.PATTERN)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]
    assert alone and not [c for c in alone if max(c) < bpe.FIRST_LATER and bpe.SINGLE.fullmatch(c)]
