"""Token counts against the tokenizer itself."""

import pytest

from revloom.llm import token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path(token_counts.TOKENIZER)
AWKWARD = [
    "a  b\tc", None, "", "  \n\t", "it's WE'LL don't rock'n'roll 'S 's''d x'", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|end",
    "3,14 1e10 x1y2 --..!?\"(quoted)\" $5.00 snake_case CamelCase", "é É é ñandú, ŁÓDŹ... İstanbul ALİ. হয়, जड़? ﬁn ½ ² Ⅷ", "漢字かな交じり文、句読点。 한국어 текст по-русски",
    "a b c\u0085d\x1ce\x00f​g", "👩‍👩‍👧 🏳️‍🌈 🙂🙂", "x" * 50_000, " ".join(f"w{i % 613}," for i in range(40_000)), "Ω ς Σ ΣΑΣ ß ẞ ǅ", "́́ ́a", "ab" * 40 + " " + "ab" * 40,
]


def expected(texts, limit=token_counts.LIMIT):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    counts = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    return [(len((x or "").encode()), n, n > limit) for x, n in zip(texts, counts, strict=True)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)


@pytest.mark.parametrize("frequent", [token_counts.FREQUENT, 20, 0])
def test_awkward_texts(spark, frequent):
    rows = [(None if i % 7 == 3 else i, t, "n") for i, t in enumerate(AWKWARD)] + [(5, AWKWARD[5], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3)
    want = [(i, *w) for (i, _, _), w in zip(rows, expected([t for _, t, _ in rows]), strict=True)]
    assert rows_of(token_counts.token_counts(docs, PATH, frequent=frequent)) == sorted(want, key=str)


def test_many_distinct_words_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "GATHERED", 50)
    texts = [" ".join(f"{a}{b}{i}" for a in "abc" for b in ("x", "é", "-")) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert rows_of(token_counts.token_counts(docs, PATH, frequent=10)) == sorted([(i, *w) for i, w in enumerate(expected(texts))], key=str)


def test_clashing_columns_and_other_names(spark):
    docs = spark.createDataFrame([("k", "one two", 1, "x", 2)], "`the id` string, body string, row int, pre_token string, doc_id int")
    found = token_counts.token_counts(docs, PATH, limit=1, id_col="the id", text_col="body").collect()
    assert [tuple(r) for r in found] == [("k", 7, 2, True)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, PATH).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows]), strict=True)]
    assert rows_of(token_counts.token_counts(docs)) == sorted(want, key=str)


def test_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        token_counts.PreTokens(public.path("byte_bpe_50k.json"))


def test_plain_words_are_cut():
    cut = token_counts.PreTokens(PATH)
    assert cut.cuts and cut.of("Größe,x1".encode()) == ["größe", ",", "x", "1"] and cut.of(b"it's") == ["it's"] and cut.of("ɓ.".encode()) == ["ɓ."]
