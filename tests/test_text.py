import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions import meta, text
from corpusmill.operators import catalog, chat
from corpusmill.sources import readers


def test_normalize_text(one):
    assert one(text.normalize_text, c="ﬁne  a​b\x07\n \n\n c\t d\n  ") == "fine ab\n c d"
    assert one(text.normalize_text, c=" \n ") == ""
    assert one(lambda c: text.normalize_text(c.cast("string")), c=None) is None


def test_remove_emoji(one):
    assert one(text.remove_emoji, c="a😀b✌c1️⃣d🇫🇷e™f") == "abcdef"


def test_clean_markdown_rule_order(one):
    assert one(text.clean_markdown, c="# Head\ntext **b** `c` [l](http://x) https://y.z\n- item\n---\nend") == (
        "text b c l \nend"
    )


def test_clean_text_and_junk(one):
    assert one(text.clean_text, c="Привет,  мир! ёж-2") == "Привет мир ёж-"
    assert one(text.junk_ratio, c="") == 0.0
    assert one(text.junk_ratio, c="ab1!") == 0.5


def test_question_and_dedupe_key(one):
    assert one(text.clean_question, c="  Что это?! ") == "что это"
    assert one(text.dedupe_key, c=" A,  b!\nC ") == "a b c"
    assert one(lambda c: text.dedupe_key(c.cast("string")), c=None) == ""


def test_trigram_similarity_is_the_known_value(one):
    assert round(one(text.trigram_similarity, a="word", b="two words"), 4) == 0.3636
    assert one(text.trigram_similarity, a="", b="") == 0.0


def test_cost_text(one):
    assert [one(text.cost_text, c=c) for c in (0.0, 0.00001234, 0.5, 2.0)] == ["0", "1.23e-05", "0.5", "2"]


def test_dates_and_extensions(one):
    assert one(text.iso_date, c="05.03.2024") == "2024-03-05"
    assert one(text.iso_date, c="2024-03-05") == "2024-03-05"
    assert one(text.iso_date, c="31.02.2024") == ""
    assert one(text.file_extension, c="/a.b/C.TAR.GZ") == "gz"
    assert one(text.file_extension, c="/a.b/c") == ""
    assert one(text.is_image, c="x.PNG") is True


def test_model_output_wrappers(one):
    assert one(text.strip_code_fence, c='```json\n{"a": 1}\n```') == '{"a": 1}\n'
    assert one(text.strip_thinking, c="<think>a\nb</think>\n\nanswer") == "answer"
    assert one(text.emphasize_links, c="see [t](https://u)") == "see *[t](https://u)*"


def test_lists(one):
    assert one(meta.comma_list, c=' "a", b ,,"" ') == ["a", "b"]
    assert one(meta.router_list, c="['x', 'y']") == ["x", "y"]
    assert one(meta.router_list, c="x, y,") == ["x", "y"]
    assert one(lambda c: meta.clean_unique(F.array(c)), c='b,"a"\nb') == ["a", "b"]
    assert one(lambda c: meta.merge_unique(F.array(c, c), F.lit(None).cast("array<string>")), c="a") == ["a"]


def test_flatten_json(one):
    nested = '{"a": {"b": ["x", "", {"c": 0}]}, "n": null, "e": []}'
    assert one(meta.flatten_json, c=nested) == {"a_b_0": "x", "a_b_1": "", "a_b_2_c": "0", "n": None}
    assert one(meta.flatten_json_without_empty, c=nested) == {"a_b_0": "x", "a_b_1_c": "0"}
    assert one(meta.flatten_json, c="no json") is None
    falsy = '{"a": 0, "b": [false, 0, {"c": ""}, "x", [1.5]], "d": {"e": null}, "f": true}'
    assert one(meta.flatten_json_without_false, c=falsy) == {"b_0": "x", "b_1_0": "1.5", "f": "true"}
    assert one(meta.flatten_json_without_empty, c=falsy) == {"a": "0", "b_0": "false", "b_1": "0", "b_2": "x", "b_3_0": "1.5", "f": "true"}


def test_chunk_header(one):
    def header(t):
        return meta.chunk_header(t, F.array(F.lit("root"), F.lit("a"), t))

    assert one(header, t="T") == "Категории: a. Заголовок: T. "
    assert one(lambda t: meta.chunk_header(t, F.array(F.lit("root"))), t="T") == "Заголовок: T. "
    assert one(lambda t: meta.chunk_header(t, F.array().cast("array<string>")), t="") == ""


def test_materials_and_source(one):
    links = {"external_links__0": "n http://u", "internal_links__0": "x"}
    pairs = F.create_map(*[F.lit(x) for kv in links.items() for x in kv])
    assert one(lambda c: meta.append_materials(c, pairs), c="t") == "t\n\nПолезные материалы:\n- n http://u"
    assert one(lambda c: meta.append_source_url(F.lit("t"), c), c="ftp://u") == "t"


def test_url_and_question_lists(one):
    assert one(readers.url_list, c='["http://a", "x"]') == ["http://a"]
    assert one(readers.url_list, c="http://a; b,https://c\n") == ["http://a", "https://c"]
    assert one(readers.question_lines, c="a\n\n b \r\n") == ["a", "b"]
    assert one(readers.csv_questions, c='"q 1";x\n;y\nq2;z') == ["q 1", "q2"]


def test_scores_and_cost(one):
    assert one(lambda c: catalog.valid_score(c, F.lit(False)), c="-2") == -2
    assert one(lambda c: catalog.valid_score(c, F.lit(False)), c="3") is None
    assert one(lambda c: catalog.valid_score(c, F.lit(False)), c="x") is None
    cost = one(lambda m: chat.token_cost(m, F.lit(1_000_000), F.lit(2_000_000)), m="gpt-4o-2024-08-06")
    assert (cost["prompt"], cost["answer"], cost["total"]) == (2.5, 20.0, 22.5)
    assert one(lambda m: chat.token_cost(m, F.lit(1), F.lit(0)), m="who")["total"] == 1.0
    assert one(lambda m: chat.token_cost(m, F.lit(1), F.lit(1), cached=True), m="o1-pro")["prompt"] is None


def test_clean_markdown_reads_marks_inside_of_marks(one):
    cases = {
        "[**b** `c`](u) *a [t](u) b* `x *y* z`": "b c a t b x y z",
        "a -- b\n***\nc __d__ ``````e": "a  b\nc d e",
        "x\n# h": "x\n",
        "#\nnext": "next",
        "1. one": "",
        "1.one *open `half [no](": "1.one *open `half [no](",
        "```code```": "``code``",
        "see http://h/*a*/b--c, here": "see  here",
    }
    for given, want in cases.items():
        assert one(text.clean_markdown, c=given) == want, given
    assert one(text.clean_markdown, c=None) is None


def test_clean_markdown_keeps_other_lines(one):
    assert one(text.clean_markdown, c="a\n## h\n1. x\n- y\nb *c* `d`\n") == "a\nb c d\n"
    assert one(text.clean_markdown, c="#no heading, -no list\n") == "#no heading, -no list\n"
    assert one(text.clean_markdown, c="see https://x.y/z, [t](u) and __n__") == "see  t and n"
    assert one(text.clean_markdown, c="") == ""


def test_normalize_text_drops_blank_lines_and_unseen_characters(one):
    assert one(text.normalize_text, c="a\x00b c﻿  \t d\r\n 　 \n\n e") == "abc d\r\n e"
    assert one(text.normalize_text, c="\n\n") == ""


def test_texts_are_composed_in_slices():
    texts = [None, "", *[f"ﬁ {i} ½ Å " * 400 for i in range(3000)]]
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    try:
        got = text.composed(column)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert peak < column.nbytes / 5
