import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import lexing
from docquarry.functions import text as T


def column(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "n int, x string")
    return [r.y for r in rows.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_titles(spark):
    paths = ["a/Falha-ao-enviar_1930133656.md", "x/a+b%2Dc_d.md", "x/50%zz.md", "x/n_12345.md"]
    assert column(spark, T.path_to_title, *paths) == ["Falha ao enviar", "a+b c d", "50%zz", "n 12345"]


def test_links_and_images(spark):
    assert column(spark, T.strip_links, "x [a [b](u) y [c] (z) [d](http://e/(f))") == ["x a [b y [c] (z) d)"]
    deep = "!" * 9 + "[a](b)" + "[c](d)" * 8
    assert column(spark, T.strip_images, "!![a](b)[c](d)", "a ![b", "x", deep, None) == ["", "a ![b", "x", "", None]


def test_lines(spark):
    text = "---\ntitle: x\n1. [home](u)\nlayout: y\n# Head\n2. [keep](u)\n --- \nCreated by me\nsee [Edit this page]\nend"
    assert column(spark, T.drop_noise_lines, text, "1. [home](u)\nplain") == ["# Head\n2. [keep](u)\nend", "plain"]


def test_chunks(spark):
    small = lambda x: T.chunk_by_headers(x, 10)
    got = column(spark, small, "aaaa\n## b\ncc", "aaaaaa\n## b", "x" * 25, "", "é" * 6)
    assert got == [["aaaa\n## b\ncc"], ["aaaaaa", "## b"], ["x" * 25], [""], ["é" * 6]]


def test_trim_and_snippet(spark):
    assert column(spark, T.trim, "\t a \n b \n") == ["a \n b"]
    assert column(spark, T.snippet, "a\nb", "x" * 201, "x" * 199 + "é" + "y") == ["a b", "x" * 200 + "...", "x" * 199 + "�..."]


def test_sanitize(spark):
    rows = spark.createDataFrame([(bytearray(b"A\xe2\x82A"),), (bytearray(b"A\xef\xbf\xbd"),), (None,)], "raw binary")
    assert [r.t for r in rows.select(T.sanitize_utf8("raw").alias("t")).collect()] == ["AA", "A�", None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("!![]()ab\n#é ")), max_size=30), min_size=20, max_size=40))
def test_expressions_equal_scanners(spark, values):
    def images(x):
        while True:
            at = x.find("![")
            end = x.find(")", at)
            if at < 0 or end < 0:
                return x
            x = x[:at] + x[end + 1 :]

    assert column(spark, T.strip_images, *values) == [images(v) for v in values]
    chunks = column(spark, lambda x: T.chunk_by_headers(x, 12), *values)
    assert ["\n".join(c) for c in chunks] == values


@pytest.mark.parametrize(
    ("word", "stem"),
    [("quilométricas", "quilométr"), ("quinhentos", "quinhent"), ("boataria", "boat"), ("boates", "boat"), ("queijo", "queij"), ("amavelmente", "amavel"), ("nação", "naçã"), ("lógicas", "lógic"), ("felizmente", "feliz"), ("comunicações", "comunic")],
)
def test_stems(word, stem):
    assert lexing.stem_portuguese(word) == stem


def test_terms():
    assert lexing.fts_terms("Como adicionar um novo UNIT_ID novo") == ["Como", "adicionar", "novo", "UNIT"]
    assert [lexing.tech_term(x) for x in ("configuração_x foo", "_a a_ b", "set A_1 then B_2")] == ["o_x", "", "A_1"]
    assert lexing.query_lexemes("como para", "portuguese") == []


def test_term_columns(spark):
    values = ["configuração_x foo", "_a a_ b", "set A_1 then B_2", "a novo NOVO Como"]
    assert column(spark, lexing.tech_term_column, *values) == ["o_x", "", "A_1", ""]
    assert column(spark, lexing.fts_terms_column, *values) == [" | ".join(lexing.fts_terms(v)) for v in values]
    assert re.match("o_x", lexing.tech_term(values[0]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Uma palavra, duas", ["uma", "palavra", "duas"]),
        ("foo-bar-beta1", ["foo-bar-beta1", "foo", "bar", "beta1"]),
        ("guarda-chuva e well-known-", ["guarda-chuva", "guarda", "chuva", "e", "well-known", "well", "known"]),
        ("http://Example.com/stuff/index.html?a=1", ["example.com/stuff/index.html?a=1", "example.com", "/stuff/index.html?a=1"]),
        ("see www.example.com. End", ["see", "www.example.com", "end"]),
        ("host.example.org:8080/x", ["host.example.org:8080/x", "host.example.org", "/x"]),
        ("ann.lee+x@mail.example.org!", ["ann.lee+x@mail.example.org"]),
        ("1.2.3 of 10.20.30 and 3.14 or -12 and +7 and 6.02e23", ["1.2.3", "of", "10.20.30", "and", "3.14", "or", "-12", "and", "+7", "and", "6.02e23"]),
        ("a <b class='x'>bold</b> &amp; &#160; t", ["a", "bold", "t"]),
        ("/usr/local/foo.txt and/or ~/x", ["/usr/local/foo.txt", "and/or", "~/x"]),
        ("2024-01-05", ["2024", "-01", "-05"]),
        ("snake_case R2D2 7z ação", ["snake", "case", "r2d2", "7z", "ação"]),
        ("", []),
        ("... --- !!", []),
    ],
)
def test_tokens(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(lexing.tokens(F.col("t")).alias("x")).first().x == want


def test_tokens_of_long_runs_are_linear(spark):
    rows = spark.createDataFrame([("a." * 60_000,), ("x-" * 60_000,), ("1." * 60_000,), ("a" * 200_000 + "@",), ("<" * 100_000,)], "t string")
    began = time.time()
    rows.select(F.size(lexing.tokens(F.col("t"))).alias("n")).collect()
    assert time.time() - began < 30


def test_lexemes_of_all_tokens(spark):
    rows = spark.createDataFrame([("Consultas em www.exemplo.com/ajuda e guarda-chuvas 2.5",)], "t string")
    got = rows.select(lexing.lexemes(F.col("t"), "portuguese", whole=True).alias("x")).first().x
    stem = lexing.stem_portuguese
    assert got == [stem("consultas"), "www.exemplo.com/ajuda", "www.exemplo.com", "/ajuda", stem("guarda-chuvas"), stem("guarda"), stem("chuvas"), "2.5"]
