"""Alignments against whole-text tokenization by the two libraries, and plain loops."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, token_alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(queries.tokenizer(A)), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(B))
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    byte = {c: v for v, c in token_alignment.packing.byte_characters().items()}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return ids_a, [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], ids_b, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]

    return tokens


def groups_of(text, libraries):
    if not text:
        return []
    ids_a, raw_a, ids_b, raw_b = libraries(text)
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return []
    ends = [{}, {}]
    for at, (raw, out) in enumerate(zip((raw_a, raw_b), ends, strict=True)):
        end = 0
        for k, r in enumerate(raw):
            end += len(r)
            ends[at][end] = k + 1
    out, i, j = [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        out.append((ids_a[i : ends[0][end]], ids_b[j : ends[1][end]]))
        i, j = ends[0][end], ends[1][end]
    return out


def expected(rows, libraries):
    """doc_id to the other columns, from all links of all documents."""
    groups = {k: groups_of(t, libraries) for k, (_, t) in enumerate(rows)}
    links = {k: [(x, y) for a, b in own for x in a for y in b] for k, own in groups.items()}
    count, highest = defaultdict(int), defaultdict(int)
    for own in links.values():
        for pair in set(own):
            count[pair] += 1
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for k, (d, _) in enumerate(rows):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups[k])
        best = sum(count[p] == highest[p[0]] for p in links[k])
        out.append((d, sum(len(a) for a, _ in groups[k]), sum(len(b) for _, b in groups[k]), len(groups[k]), len(links[k]), best, sum(count[p] for p in links[k]), text))
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "a"), (6, " a  b "), (6, "a repeated id"), (None, "no id"), (7, "two\n\n lines \t tab\r\n end "), (8, "don't 's it's"), (9, "<s> <|endoftext|> </s><unk>"), (10, "x▁y"),
    (11, "naïve café ﬁne ½ ② 12345 \U0001f600 　 wide"), (12, "北京大学 の テキスト"), (13, "a\x00b\x07c \x1c d\x85 e\xa0f \xa0 g"), (14, "a" * 5000), (15, " " * 5000 + "x"), (16, "1234567890" * 300), (17, "ab cd " * 3000), (18, "é Å"), (19, "  x    y"), (20, "end \n"), (21, " \xa0 \xa0x"),
]


def test_odd_texts(spark, libraries):
    df = spark.createDataFrame([(d, t, "k", 1, [3], 0) for d, t in ODD], "doc_id long, text string, groups string, row int, used array<int>, k0 int").repartition(3)
    made = token_alignment.align(df, queries.tokenizer(A), queries.tokenizer(B))
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r) for r in made.collect()), key=repr) == expected(ODD, libraries)
    assert token_alignment.align(df.limit(0), queries.tokenizer(A), queries.tokenizer(B)).count() == 0


def test_op11(spark, sf_dir, libraries, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    told = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in expected([tuple(r) for r in docs], libraries)]
    made = queries.op11_token_alignment(spark, sf_dir)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted(told, key=repr)
    # keys that are shuffled, and not broadcast, give the same
    monkeypatch.setattr(token_alignment, "SHARES", 20)
    assert sorted((tuple(r) for r in queries.op11_token_alignment(spark, sf_dir).collect()), key=repr) == sorted(told, key=repr)


def test_long_texts_go_in_parts(spark, libraries, monkeypatch):
    """Whatever the parts' length, and however few links a group may have before its ids are made distinct."""
    text = " ".join(t for _, t in ODD if t and "▁" not in t)
    own = token_alignment.Aligner(queries.tokenizer(A), queries.tokenizer(B))
    told = expected([(1, text)], libraries)[0]
    for part, most in ((1 << 20, 1 << 20), (50, 1), (7, 4), (1, 1 << 20)):
        monkeypatch.setattr(token_alignment, "PART", part)
        monkeypatch.setattr(token_alignment, "MANY_LINKS", most)
        found = own.align([None, text, "", text])
        assert found.texts() == ["", told[-1], "", told[-1]]
        assert [c.tolist() for c in found.counts()] == [[0, n, 0, n] for n in told[1:5]]
        batch = token_alignment._batch(0, token_alignment.pa.array([1, 2, 3, 4]), found, set()).to_pylist()
        links = [{(x, y) for x in a for y in b} for a, b in {(tuple(a), tuple(b)) for a, b in groups_of(text, libraries)}]
        several = {p: n - 1 for p, n in Counter(p for own in links for p in own).items() if n > 1}
        assert {(r["a"], r["b"]): r["times"] for r in batch[1]["again"]} == several


def test_links_are_expanded_once_for_each_group(spark):
    """The dictionary has as many rows as there are distinct groups, however many documents repeat them."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("the same few words 2024 in each text").alias("text"))
    told = token_alignment.tokenized(df, queries.tokenizer(A), queries.tokenizer(B))
    groups = told.select(F.explode(F.split("groups", ";")).alias("g")).distinct().count()
    dictionary = token_alignment.group_dictionary(told)
    assert dictionary.count() == groups
    assert {r.documents for r in dictionary.collect()} == {300}
    assert {r.documents for r in token_alignment.link_counts(told, dictionary).collect()} == {300}
