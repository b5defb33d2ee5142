"""A clean text is accepted however long it is."""

import random

from transitmill.llm import langid

LETTERS = {"aa": "abcdefghijklm", "bb": "jklmnopqrstuvwxyz"}


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_margin_holds_for_long_texts():
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choice(own) for _ in range(rng.randint(3, 9))) for _ in range(4000)] for lang, own in LETTERS.items()}
    model = langid.Model(tuple((lang, prose(rng, own, 15_000).encode()[-110_000:]) for lang, own in vocabulary.items()))
    for lang, own in vocabulary.items():
        for n in (500, 20_000, 600_000):
            found, _, rejected = langid.identify(prose(rng, own, n), model)
            assert (found, rejected) == (lang, False), n
    both = prose(rng, vocabulary["aa"] + vocabulary["bb"], 5)
    assert langid.identify("", model)[2] and langid.identify(both, langid.Model((("aa", b"zzzz"), ("bb", b"zzzz"))))[2]


def test_signs_that_stand_for_numbers_are_no_letters():
    model = langid.Model((("aa", b"zzzz"), ("bb", b"abab")))
    for text in ("½ ²", "Ⅷ", "①②", "123", "٣", "̈", "_", "", None):
        assert langid.identify(text, model)[0] == langid.UNKNOWN, text
    for text in ("ª", "x½", "漢", "ǅ"):
        assert langid.identify(text, model)[0] != langid.UNKNOWN, text


def test_a_sample_of_repeated_ids_is_bounded_and_has_a_dictionary(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("many rows of one id "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    for doc_id in (1, 2, 3):
        model = langid.fit(rows.withColumn("doc_id", F.lit(doc_id).cast("long")))
        assert [label for label, _ in model.dictionaries] == ["xx"]
        assert len(model.dictionaries[0][1]) < 100


def test_sizes_are_those_of_plain_compression():
    """The score and the language from sizes computed with fresh compressors, text by text."""
    import zstandard

    rng = random.Random(4)
    vocabulary = {lang: ["".join(rng.choice(own) for _ in range(5)) for _ in range(300)] for lang, own in LETTERS.items()}
    held = {lang: prose(rng, own, 2000).encode() for lang, own in vocabulary.items()}
    model = langid.Model(tuple(held.items()))
    for n in (1, 3, 40, 9000):
        text = prose(rng, vocabulary[rng.choice("aa bb".split())], n)
        sizes = {}
        for lang, raw in held.items():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=model.level)
            plain = lambda data, own=own: zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data)
            sizes[lang] = sum(len(plain(text[i : i + langid.WINDOW].encode())) for i in range(0, len(text), langid.WINDOW))
        low, high = sorted(sizes.values())
        found, score, rejected = langid.identify(text, model)
        assert sizes[found] == low and rejected == (high - low < max(1, model.min_margin * high))
        assert abs(score - 1 / (1 + 2.0 ** -min(high - low, 60))) < 1e-12
