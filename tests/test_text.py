import hashlib

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import quality as Q


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column.alias("v")).first()["v"]


def test_signature_value(spark):
    known = "2b02f9402c14344b242b98b52e00b097f868c133def2033e5f93207eb2530319"
    assert one(spark, X.signature(F.col("t")), t="Gode norskkunnskaper.") == known == hashlib.sha256(b"gode norskkunnskaper").hexdigest()


def test_digits_that_state_a_level_stay(spark):
    c = lambda t: one(spark, X.canonical(F.col("t")), t=t)
    assert c("Krav: B2 norsk, 12 stillinger") == "krav b2 norsk # stillinger"
    assert c("tilsvarende nivå 12, 5 år") == "tilsvarende nivå 12 # år"


def test_place_suffixes_go(spark):
    p = lambda t: one(spark, X.place_key(F.col("t")), t=t)
    assert [p(t) for t in ("Oslo-området", "Bergen og omegn", "the Oslo area", "NATION_3 kommune")] == ["oslo", "bergen", "the oslo", "nation_3"]


def test_ngrams_of_long_words_only(spark):
    assert one(spark, X.char_ngrams(F.col("w")), w="kort") == []
    assert len(one(spark, X.char_ngrams(F.col("w")), w="sykepleier")) == 8 + 7 + 6


def test_scrub():
    out = X.scrub_item("Ring 950 27 028 eller 28.10.2026 08.00-16.00, a.b@c.no. Kari Nordmann 920 99272", [{"name": "Kari Nordmann", "phone": "+47 92099272"}])
    assert out == "Ring [telefon fjernet] eller 28.10.2026 08.00-16.00, [e-post fjernet]. [navn fjernet] [telefon fjernet]"
    assert X.scrub_item(out, []) == out and X.scrub_item(None, None) == ""


def test_scrub_patterns_as_column(spark):
    assert one(spark, X.scrub_patterns(F.col("t")), t="Ring 950 27 028, ikke 28.10.2026; a.b@c.no") == "Ring [telefon fjernet], ikke 28.10.2026; [e-post fjernet]"


def test_html_blocks():
    b = X.html_blocks_of("<div>Hei <b>du</b><p>En<br>To</p><ul><li>Norsk kreves: <p>Norsk</p></li><script>x</script></ul></div>")
    assert [(x["tag"], x["text"]) for x in b] == [("div", "Hei du"), ("p", "En"), ("p", "To"), ("li", "Norsk kreves:"), ("p", "Norsk")]
    assert [x["text"] for x in X.html_blocks_of("a line\n\nanother")] == ["a line", "another"]
    assert X.html_blocks_of(None) == []


def test_span_verdicts():
    body = "Krav:\n· Gode norskkunnskaper er viktig\nDu behersker norsk eller engelsk. Vi ser"
    assert Q.span_verdict("Gode norskkunnskaper er viktig", body) == (True, "")
    assert Q.span_verdict("behersker norsk eller engelsk.", body) == (False, "starts_mid_sentence")
    assert Q.span_verdict("Du behersker norsk eller", body) == (False, "ends_mid_sentence")
    assert Q.span_verdict("norsk", body) == (False, "fragment_too_short")
    assert Q.span_verdict("nothing like this here", body) == (False, "not_verbatim")
    assert Q.span_verdict("Vi krever gode norskkunnskaper", "Vi krever gode norskkunnskaper\n[...]\nmer") == (False, "truncated_fragment")


def test_byte_chunks():
    assert Q.byte_chunks([5, 5, 20, 3, 3], 10) == [0, 0, 1, 2, 2]


def test_stem_chain():
    strip = lambda w: w[:-1] if w.endswith("e") else w
    assert X.stem_chain("seree", [strip, strip]) == ["seree", "sere", "ser"]
