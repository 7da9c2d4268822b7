import pytest
from pyspark.sql import functions as F

from themeloom.functions import monitor, scores, text, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_doc_text_keeps_the_space_of_a_missing_part(spark):
    doc = text.doc_text(F.lit(None).cast("string"), F.lit("b"))
    assert one(spark, doc) == " b"
    assert one(spark, text.doc_text(F.lit("a"), F.lit(None).cast("string"))) == "a "


def test_stop_words_go_before_ngrams(spark):
    tokens = text.remove_stop_words(text.tokenize(F.lit("State of the art, a état")), ["of", "the"])
    assert one(spark, text.ngrams(tokens)) == ["state", "art", "état", "state art", "art état"]


@pytest.mark.parametrize("words,expected", [("", []), ("ab", ["ab"]), ("ab ab", ["ab", "ab", "ab ab"])])
def test_ngrams_of_short_texts(spark, words, expected):
    assert one(spark, text.ngrams(text.tokenize(F.lit(words)))) == expected


def test_topic_label(spark):
    words = F.array(*[F.lit(w) for w in "a b c d e".split()])
    assert one(spark, text.topic_label(F.lit(7), words)) == "7_a_b_c_d"
    assert one(spark, text.topic_label(F.lit(-1), words)) == "-1_noise"


@pytest.mark.parametrize("n_left,n_right,limit", [(a, b, m) for a in range(6) for b in range(6) for m in (1, 4, 5)])
def test_kept_lengths_follow_the_longer_side(spark, n_left, n_right, limit):
    first, second = n_left, n_right
    short, long = min(first, second), max(first, second)
    if short + long > limit:
        short = min(short, limit // 2)
        long = limit - short
    expected = (long, short) if n_left > n_right else (short, long)
    a, b = text.kept_lengths(F.lit(n_left), F.lit(n_right), limit)
    assert one(spark, F.concat_ws(",", a, b)) == ",".join(map(str, expected))


def test_label_names_and_templates(spark):
    assert one(spark, text.normalize_label(F.lit(" not-so good "))) == "NOT_SO_GOOD"
    assert one(spark, text.format_hypothesis("This is {}.", F.lit("x"))) == "This is x."


def test_wide_columns_sort_by_number():
    assert vectors.embedding_columns(["V10", "id", "V2", "Vx", "V1", "v3"]) == ["V1", "V2", "V10"]


def test_pack_without_vectors_fails(spark):
    with pytest.raises(ValueError, match="no embedding columns"):
        vectors.pack_embedding(spark.range(1))


def test_validation_counts(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    got = vectors.validate_embeddings(df, 2).first().asDict()
    assert got == {"n_rows": 5, "n_missing": 1, "n_wrong_width": 1, "n_nan": 1, "n_zero": 1}


def test_zero_vectors_do_not_divide_by_zero(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, vectors.cosine(zero, unit)) == 0.0


@pytest.mark.parametrize(
    "etime,minutes", [("01:05", 65 / 60), ("01:00:15", 60.25), ("2-01:00:00", 2940.0), ("7", None), ("", None)]
)
def test_etime(spark, etime, minutes):
    got = one(spark, monitor.etime_to_minutes(F.lit(etime)))
    assert got == (None if minutes is None else pytest.approx(minutes))


def test_throughput_bar_is_clamped(spark):
    assert one(spark, monitor.throughput_bar(F.lit(99.0), 25, 4)) == "████"
    assert one(spark, monitor.throughput_bar(F.lit(-1.0), 25, 4)) == "░░░░"
    assert one(spark, monitor.throughput_bar(F.lit(12.5), 25, 4)) == "██░░"
    assert one(spark, monitor.throughput_bar(F.lit(5.0), 0, 4)) == "░░░░"


def test_memory_share_falls_back_to_the_host(spark):
    none = F.lit(None).cast("double")
    assert one(spark, monitor.memory_share(F.lit(50.0), none, F.lit(200.0))) == 25.0
    assert one(spark, monitor.memory_share(F.lit(50.0), F.lit(100.0), F.lit(200.0))) == 50.0


def test_host_label(spark):
    assert one(spark, monitor.host_label(F.lit("https://abc123-8080.proxy.example.net/metrics"))) == "abc123"
    assert one(spark, monitor.host_label(F.lit("http://a-b-80.x/y"))) == "a-b"


def test_equal_scores_keep_request_order(spark):
    got = one(spark, scores.rank_scores(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.2)), ["a", "b", "c"]))
    assert got["labels"] == ["b", "a", "c"] and got["scores"] == [0.5, 0.2, 0.2]


def test_softmax_of_large_logits(spark):
    assert one(spark, scores.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
