import random
import string

from papyra.llm import secrets as X


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [bool(r["spans"]) for r in X.find_secrets(df).orderBy("doc_id").collect()]


def signs(n, alphabet, seed=1):
    return "".join(random.Random(seed).choices(alphabet, k=n))


ALNUM = string.ascii_letters + string.digits


def test_allowed_parts_do_not_hide_the_rest(spark):
    key = signs(40, ALNUM)
    texts = [
        "https://discord.com/api/webhooks/123456789012345678/" + signs(68, ALNUM + "-_"), f"prod-service-token-{key}",
        f"https://host.org/example/{key}", f"550e8400-e29b-41d4-a716-446655440000/{key}",
    ]
    assert all(found(spark, texts))
    url_safe = [signs(86, ALNUM + "-_", seed) for seed in range(300)]
    assert sum(found(spark, url_safe)) >= 299


def test_allowed_parts_alone_are_no_secrets(spark):
    texts = [
        "src/main/java/org/apache/spark/sql2024/Column12", "550e8400-e29b-41d4-a716-446655440000", "placeholder-1234-changeme-5678",
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "sha256-KEY9sdfJKH34kjhDFGkj345kjhSDFkjh", "see-also-chapter-12-and-13",
    ]
    assert found(spark, texts) == [False] * len(texts)


def test_candidates_of_every_class_are_scored(spark):
    letters = [signs(32, string.ascii_letters, seed) for seed in range(200)]
    assert sum(found(spark, letters)) >= 198
    lower = [signs(32, string.ascii_lowercase, seed) for seed in range(200)]
    assert sum(found(spark, lower)) >= 150
    alnum = [signs(20, ALNUM, seed) for seed in range(300)]
    assert sum(found(spark, alnum)) >= 290


def test_words_are_no_secrets(spark):
    texts = [
        "keitstlichschenverpfeinungtzheit", "getElementByIdFromTheDocument", "AbstractSingletonProxyFactoryBean",
        "state-of-the-art-methods", "z" * 200, "ein" * 30, "-" * 60, "Rindfleisch-Etikettierung-Gesetz",
    ]
    assert found(spark, texts) == [False] * len(texts)


def test_a_run_of_one_hex_digit_is_a_base_match_only(spark):
    df = spark.createDataFrame([(1, "a" * 200)], "doc_id long, text string")
    spans = X.find_secrets(df).first()["spans"]
    assert [(X.KINDS[s["kind"]], s["start"], s["end"]) for s in spans] == [("hex", 0, 200)]
