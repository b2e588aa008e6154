"""Secrets, token counts, language ID, sharding, BPE and toxicity against brute force, libraries and held-out labels."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from loomtext.llm import byte_bpe, lang_id, secret_scan, sharding, token_counts, toxicity

from .conftest import sentence

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n", "é", "𝒳 astral 𝒳", "x" * 70_000, "a b " * 30_000, "tab\tand\r\nline", "日本語 テキスト"]


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(out)]


def test_secrets_against_plain_expressions(docs):
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "AKIA", "akia", " ", "  ", "=", ":", '"', "'", "é", "😀", "0123456789abcdef", "deadbeef", "ABCDEFGH1234", "x", "\n", "/+_.-", "ſecret", "f"]
    rows = list(enumerate(["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)] + ODD + ["f" * 31 + "g" + "f" * 32 + "x", "a" * 9000]))
    good = "ghp_" + (body := "0123456789ABCDEFGHIJabcdefghij") + secret_scan.checksum(body)
    rows += [(9000, "é " + good + " end"), (9001, good[:-1] + ("0" if good[-1] != "0" else "1")), (9002, "token: " + good)]
    got = {r["doc_id"]: r for r in secret_scan.scan(docs(rows)).collect()}
    for i, text in rows:
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
    assert "github:2:42" in got[9000]["spans"] and "github" not in got[9001]["spans"] and got[9002]["n_checked"] == 1
    assert secret_scan.scan(docs([])).count() == 0


def library_counter(vocab, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    unk = next(k for k, (p, _) in enumerate(vocab) if p == "<unk>")
    tok = Tokenizer(models.Unigram(vocab, unk, byte_fallback))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


def test_token_counts_against_library(spark, docs):
    vocab = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    count = library_counter(vocab, True)
    texts = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()] + ODD[3:6] + ["<0x41> ▁▁ x  y ", " lead"]
    rows = list(enumerate(texts + [None, ""]))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(rows), vocab).collect()}
    for i, t in rows:
        assert got[i] == (count(t) if t else 0), t
    assert token_counts.count_tokens(docs([]), vocab).count() == 0


def test_token_count_ties_and_unknown_runs():
    rng = random.Random(8)
    for trial in range(60):
        pieces = {"▁"} | {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(6)}
        vocab = [("<unk>", -20.0)] + [(p, -float(rng.randrange(1, 5))) for p in sorted(pieces)]
        mine, theirs = token_counts.UnigramCounter(vocab, False), library_counter(vocab, False)
        for _ in range(20):
            text = "".join(rng.choice("aabbc ") for _ in range(rng.randrange(1, 12)))
            assert mine.text(text)[0] == theirs(text), (vocab, text)


def test_language_id(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"
    protos = lang_id.train(table.where(f"NOT {held}"))
    assert set(protos) == {"en", "de", "fr", "es"}
    got = lang_id.predict(table.where(held), protos, keep=[table["lang"]]).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = {r["doc_id"]: r for r in lang_id.predict(docs(list(enumerate(ODD)) + [(None, "the end")]), protos).collect()}
    assert [odd[k]["lang_pred"] for k in range(4)] == ["und"] * 4 and odd[0]["score"] == 0 and odd[4]["lang_pred"] != "und"
    assert lang_id.predict(docs([]), protos).count() == 0
    assert lang_id.train(docs([]).selectExpr("doc_id", "text", "'en' AS lang")) == {}
    assert lang_id.predict(docs([(1, "word")]), {}).first()["lang_pred"] == "und"


def test_language_vectors_against_plain_sum():
    texts = ["Ab cab", "x", None, "", "Ünder 12 ab!"]
    got = lang_id.document_vectors(texts, 128)
    for row, text in zip(got, texts, strict=True):
        low = "".join(c.lower() if c.isalpha() else " " for c in text or "")
        low = " " + " ".join(low.split()) + " " if low.strip() else ""
        v = lambda c: lang_id.letter_vectors(np.array([ord(c)], np.uint32), 128)[0]
        want = sum((np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in zip(low, low[1:], low[2:])), np.zeros(128))
        assert (row == want).all()


def test_sharding(docs):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randrange(1, 60))) for i in range(3000)] + [(i, "same") for i in range(3000, 4500)] + list(enumerate([t for t in ODD if len(t or "") < 1000], 9000)) + [(7, "again"), (7, "again"), (None, None)]
    got = sharding.shard_records(docs(rows)).toPandas()
    assert len(got) == len(rows)
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 8 and by.max() - by.min() <= 0.005 * by.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None}
    assert set(zip(got["doc_id"].dropna().astype(int), got.loc[got["doc_id"].notna(), "size"], got.loc[got["doc_id"].notna(), "text_crc32"])) == want
    assert got.groupby("vslot")["shard"].nunique().max() == 1
    assert sharding.shard_records(docs([])).count() == 0


def test_stored_map_is_edited(spark, docs, tmp_path):
    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randrange(1, 60))) for i in range(2000)]
    path = str(tmp_path / "map")
    sharding.shard_records(docs(rows), slots=256, map_path=path).count()
    last, first = sharding.stored_map(spark, path)
    assert last == 1 and spark.read.parquet(path).groupBy("version").count().count() == 2
    again = sharding.shard_records(docs(rows), slots=256, map_path=path)
    assert sharding.stored_map(spark, path)[0] == 1 and {r["vslot"]: r["shard"] for r in again.collect()}.items() <= first.items()
    more = docs(rows + [(i, sentence(rng, 50)) for i in range(2000, 2200)])
    by = sharding.shard_records(more, slots=256, map_path=path).groupBy("shard").sum("size").toPandas()["sum(size)"]
    last, second = sharding.stored_map(spark, path)
    assert last == 2 and sum(first[s] != second[s] for s in first) < 100 and by.max() - by.min() <= 0.02 * by.mean()
    sharding.shard_records(docs(rows), shards=6, slots=256, map_path=path).count()
    assert set(sharding.stored_map(spark, path)[1].values()) == set(range(6))


def test_rebalance_moves_few_slots(spark):
    rng = random.Random(1)
    old, sizes = sharding.first_map(8, 512), {s: rng.randrange(1, 1000) for s in range(512)}
    new = sharding.rebalance(old, sizes, 8)
    load = [sum(sizes[s] for s in new if new[s] == k) for k in range(8)]
    assert max(load) - min(load) <= 0.002 * sum(load) / 8 + 1 and sum(old[s] != new[s] for s in old) < 200
    assert sharding.rebalance(old, {}, 8) == old
    lone = sharding.rebalance(old, sizes | {3: 10**6}, 8)
    rest = [sum(sizes[s] for s in lone if lone[s] == k and s != 3) for k in range(8) if k != lone[3]]
    assert max(rest) - min(rest) <= 500
    assert sharding.map_rows(spark, [old, new]).count() == 1024


def test_byte_bpe_round_trip(docs):
    import base64

    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rng = random.Random(7)
    long = "".join(rng.choice(["word", " ", "  ", "\n", " ", "é", "9", "'s", "!", " 日本", "<|endoftext|>"]) for _ in range(120_000))
    rows = [(i, t) for i, t in enumerate([*ODD, long, long[:70_000] + " " * 3000 + "x" + long[:70_000]])]
    got = {r["doc_id"]: r for r in byte_bpe.token_digests(docs(rows), ranks, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert "".join(byte_bpe.pieces(long, 1000)) == long
    assert byte_bpe.token_digests(docs([]), ranks, public_tokenizers.PATTERN).count() == 0
    both = byte_bpe.decode_column(byte_bpe.encode_column(docs(rows[:6]), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both.collect())


def test_byte_bpe_long_runs(docs):
    """Runs that the library's matcher cannot walk: ids as those of shorter runs, and an exact round trip at two million."""
    import base64

    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rng = random.Random(3)
    for run in (" " * 5000, "\n" * 5000, "\r\n" * 2500, "".join(rng.choice(" \t\n\u00a0\u3000\x1c\u2028\x85") for _ in range(20_000)), " " * 4095, " " * 4096, " " * 4097):
        for text in (run, "a" + run, run + "b", "a" + run + "b c", "1" + run + "!" + run, run + "x" + run + "\x1cx"):
            assert byte_bpe.encode(text, ranks, public_tokenizers.PATTERN).tolist() == plain.encode_ordinary(text)
    n = 2_000_000
    long = [" " * n, "\n" * n, " \t\n" * (n // 3), "word" + " " * n + "word", "\u65e5" * n, "x" * n, "^" * n, "a b" * (n // 3)]
    got = {r["doc_id"]: r for r in byte_bpe.token_digests(docs(list(enumerate(long))), ranks, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(long):
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and 0 < got[i]["n_tokens"] <= 3 * n


def plain_neighbours(examples, text, share, k):
    """TF-IDF cosines of every example by dictionaries, nearest first, ties by id."""
    counts = [toxicity.terms(t) for _, _, t in examples]
    df = pd.Series([t for c in counts for t in c]).value_counts().to_dict()
    df = {t: n for t, n in df.items() if n >= max(2, share * len(examples))}

    def unit(c):
        v = {t: n * np.log((len(examples) + 1) / df[t]) for t, n in c.items() if t in df}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    q = unit(toxicity.terms(text))
    found = []
    for (i, y, _), c in zip(examples, counts, strict=True):
        v = unit(c)
        found.append((-sum(x * v[t] for t, x in q.items() if t in v), i, y))
    return [(i, -s, y) for s, i, y in sorted(found) if s < 0][:k]


def test_neighbours_are_exact(spark, docs):
    """Ids, cosines and labels of the evidence are those of plain TF-IDF over all labelled rows, over many blocks, ties included."""
    rng = random.Random(3)
    pool = [rng.choice("abcdefgh") * rng.randrange(1, 3) + rng.choice(["lo", "trash", "scumlike", "e", "kraftwerk"]) for _ in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    texts += texts[:20] + ["", "  ", "12 3", texts[0] + " " + texts[0]]
    rows = list(enumerate(texts))
    marks = [(i, rng.randrange(2)) for i, _ in rows[:330]]
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs([*rows, rows[7], (None, "lo")]), labels, block=16)
    assert index.blocks > 10 and len(index.ids) == len({i for i, _ in marks} & {i for i, _ in rows})
    got = {r["doc_id"]: r for r in toxicity.score(docs(rows), index).collect()}
    examples = [(i, y, texts[i]) for i, y in marks if i < len(texts)]
    for i, text in rows[::3] + rows[-6:]:
        want = plain_neighbours(examples, text, toxicity.MIN_SHARE, toxicity.NEIGHBOURS)
        have = [(e["id"], e["cosine"], e["label"]) for e in got[i]["evidence"]]
        assert [c for _, c, _ in have] == pytest.approx([c for _, c, _ in want], abs=1e-12)
        clear = [k for k in range(len(want)) if all(abs(want[k][1] - w[1]) > 1e-9 for j, w in enumerate(want) if j != k) and want[k][1] > want[-1][1] + 1e-9]
        assert [have[k] for k in clear] == [(want[k][0], pytest.approx(want[k][1], abs=1e-12), want[k][2]) for k in clear]
        assert have == sorted(have, key=lambda e: (-e[1], e[0]))
    assert index.nbytes() <= 24 * sum(len(toxicity.terms(t)) for _, _, t in examples) + 16 * len(index.place) * (index.blocks + 1) + 64 * len(examples)


def test_toxicity(spark, docs):
    table, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = table.join(labels, "doc_id")
    held = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0"
    index = toxicity.fit(table.where(f"NOT {held}"), labels)
    got = toxicity.score(known.where(held), index).join(labels, "doc_id").toPandas()
    assert got["score"].between(0, 1).all()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
    assert auc > 0.96 and got[(got.toxic == 0) & (got.predicted == 1)].shape[0] <= 0.01 * len(neg) and (pos >= 0.5).mean() > 0.7
    for lo in np.arange(0, 1, 0.1):
        bin_ = got[(got.score >= lo) & (got.score < lo + 0.1)]
        assert len(bin_) < 50 or abs(bin_.score.mean() - bin_.toxic.mean()) < 0.05
    assert (got.evidence.map(len) > 0).mean() > 0.99 and index.nbytes() < 30e6
    odd = toxicity.score(docs(list(enumerate(ODD)) + [(None, "trash")]), index).collect()
    assert len(odd) == len(ODD) + 1 and odd[0]["score"] == pytest.approx(index.base)
    nothing = toxicity.fit(docs([]), labels)
    assert toxicity.score(docs([(1, "word")]), nothing).first()["predicted"] == 0
    assert pd.DataFrame(toxicity.score(docs([]), index).collect()).empty


def test_toxic_words_in_long_texts(spark, docs):
    """One toxic word with an ending that no example has, or one pair of letters in a text without blanks, outweighs a long clean text."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(3000)]
    ends = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou")) for _ in range(40)]
    kanji = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]

    def text(k, toxic, ends):
        if k % 4 == 0:
            words = [rng.choice(kanji) for _ in range(rng.randrange(20, 400))]
            return "".join([*words[:15], *["死ね"] * toxic, *words[15:]])
        words = [pool[min(int(rng.paretovariate(0.4)), 2999)] for _ in range(rng.randrange(20, 400))]
        for _ in range(toxic):
            words.insert(rng.randrange(len(words)), "vequ" + rng.choice(ends))
        return " ".join(words)

    rows = [(k, text(k, (k // 4) % 8 == 0, ends[:30])) for k in range(1600)]
    index = toxicity.fit(docs(rows), spark.createDataFrame([(k, int((k // 4) % 8 == 0)) for k, _ in rows], "doc_id long, toxic int"))
    new = [(k, text(k, k % 2, ends[30:])) if k % 4 else (k, text(k, (k // 4) % 2, ends)) for k in range(400)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(new), index).collect()}
    for unspaced in (False, True):
        own = [k for k in got if (k % 4 == 0) == unspaced]
        toxic = [got[k] for k in own if (k // 4 if unspaced else k) % 2]
        clean = sorted(got[k] for k in own if not (k // 4 if unspaced else k) % 2)
        assert np.mean(np.array(toxic) > clean[int(0.9 * len(clean))]) >= 0.95
        assert unspaced or np.mean(np.array(toxic) >= 0.5) >= 0.8


def test_neighbours_by_matrix_and_lists(spark):
    """The same neighbours as plain cosines where few terms stand in matrices, over blocks, copies tied and a huge count too;
    many texts at once take less of a task's CPU time than walking the posting lists text by text."""
    rng = np.random.default_rng(5)
    drawn = [dict(Counter(np.minimum(rng.zipf(1.25, 400), 3000).tolist())) for _ in range(2200)]
    examples = [(i, int(i % 7 == 0), {t - 1: n for t, n in c.items()}) for i, c in enumerate(drawn[:2000])]
    examples += [(5000 - i, y, c) for i, y, c in examples[:40]] + [(3, 0, {7: 2, 2998: 1})] + [(6000, 1, {0: 1 << 25, 5: 3}), (6001, 0, {})]
    held = Counter(t for _, _, c in examples for t in c)
    df = {f"{t:04}": held[t] for t in range(3000)}  # a place is the number itself

    def measure(cells, block):
        index = toxicity.NeighbourIndex({t: max(n, 1) for t, n in df.items()}, len(examples), examples, 0.1, block, cells=cells)
        dense = np.zeros((len(examples), len(df)))
        for e, (_, _, c) in enumerate(examples):
            dense[e, list(c)] = list(c.values())
        dense *= index.idf
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
        lists = [(np.flatnonzero(col), col[np.flatnonzero(col)]) for col in dense.T]
        asked = [index.vector(np.array([t - 1 for t in c]), np.array(list(c.values()))) for c in drawn[1900:]] + [index.vector(np.array([0, 9]), np.array([7, 1]))]
        index.nearest(asked[:1])
        began = time.process_time()
        got = index.nearest(asked)
        own, want = time.process_time() - began, []
        began = time.process_time()
        for at, x in asked:
            found = [lists[t] for t in at]
            row, weight = np.concatenate([r for r, _ in found]), np.concatenate([w for _, w in found])
            want.append(np.bincount(row, weight * np.repeat(x, [len(r) for r, _ in found]), len(examples)))
        return len(index.common), got, want, own / (time.process_time() - began)

    ids = np.array([i for i, _, _ in examples])
    for cells, block in ((1 << 22, 4608), (100_000, 700), (0, 4608)):
        common, got, want, share = spark.sparkContext.parallelize([0], 1).map(lambda _, c=cells, b=block: measure(c, b)).first()
        assert common == min(2999, cells // len(examples), sum(n > 0 for n in df.values()) - 1) and len(got) == len(want)
        for near, cosines in zip(got, want, strict=True):
            best = np.argsort(-cosines)[:16]
            assert [s for _, s, _ in near] == pytest.approx(cosines[best].tolist(), abs=1e-12)
            assert near == sorted(near, key=lambda f: (-f[1], f[0])) and all(np.abs(cosines[ids == i] - s).min() < 1e-12 for i, s, _ in near)
        assert cells < 1 << 22 or share < 0.8, share


def test_words_of_latin_texts():
    """The quick way for Latin-1 finds what the expression finds, in every character."""
    for text in [f"Ab{chr(c)}cÀ {chr(c)}" for c in range(0x3000)] + ["", "a1b_c²x ¼ ªº\x85ß\xa0Ÿ", "İI ΣΑΣ"]:
        assert toxicity.words_of(text) == toxicity.WORD.findall(text.lower())
    assert toxicity.words_of(None) == []


def test_leaning_of_words():
    """A word leans as its most toxic stem does, however it is found, and words are forgotten without a trace."""
    rng = random.Random(8)
    draw = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 13)))
    votes = {s: (9, rng.randrange(10)) for s in {s for _ in range(60) for s in rng.sample(toxicity.stems(draw()), 1)} | {"死ね", "死ね$"}}
    place = ["ab", "aabab", "~aababb", "bbé", "~ababab"]
    index = toxicity.NeighbourIndex(dict.fromkeys(place, 2), 9, [], 0.2, votes=votes)
    words = [draw() for _ in range(2000)] + ["死ね", "x死ね", "見死ね人", "ab"]
    for _ in range(2):
        assert [len(x) for x in index.read(None)[:2]] == [0, 0] and index.read("12")[2] == 0.0
        for w in words:
            at, n, added = index.read(w)
            assert added == max(index.leaning(*votes.get(s, (0, 0))) for s in toxicity.stems(w))
            assert [sorted(place)[k] for k in at] == sorted({t for t in toxicity.terms_of(w) if t in place}) and (n == 1).all()
        index.met.forget()
