"""Edge cases, a row each, met by the parts table (part number modulo the number of cases), and what each must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, maths, parse
from ..functions import text as T
from ..operators import clean, dedup, errors, evaluate, filters, records
from ..operators.tables import spread
from .pairs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _sql(x: str | None) -> str:
    return "null::varchar" if x is None else "'" + x.replace("'", "''") + "'"


def _cases(name: str, schema: str, rows: list[tuple], result: Callable[[], Column]) -> None:
    """rows: inputs by the schema, then the expected result as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"case int, {schema}")
        parts = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.pmod("p_partkey", F.lit(len(rows))).cast("int").alias("case"))
        return parts.join(F.broadcast(given), "case").select("p_partkey", "case", result().cast("string").alias("result"))

    run.__name__, run.__doc__ = name, f"{len(rows)} cases"
    QUERIES[name] = run
    values = ", ".join(f"({i}, {_sql(r[-1])})" for i, r in enumerate(rows))
    ORACLES[name] = f"select p_partkey, c.n as \"case\", c.result from part join (values {values}) c(n, result) on p_partkey % {len(rows)} = c.n"


C = F.col
_T = "t string"


def _join(c: Column) -> Column:
    """An array of texts as one, nulls shown."""
    return F.array_join(c, "|", "NULL")


_cases("edge_unicode", _T, [("и\u0306", "й"), ("a\u200bb\u00adc", "abc"), ("м\u02bcя\u2019", "м'я'"), ("\u00a0x\u00a0y\u00a0", "x\u00a0y"), ("a \t\t b", "a b"), ("\u200b\u0007 ", ""), (None, ""), (" a\nb ", "a\nb")], lambda: T.unicode_clean(C("t")))
_cases("edge_fences", _T, [("```json\nx y\n```", "x y"), ("``` x ```", "x"), ("x", "x"), ("", "")], lambda: T.strip_fences(C("t")))
_cases("edge_quotes", _T, [(" «Так» ", "Так"), ('"a\'', "a"), ("„b“ c", "b“ c"), ("", "")], lambda: T.peel_quotes(C("t")))
_cases("edge_predictions", _T, [("<think>a\nb</think> \"x  y\"", "x y"), ("''z''", "z"), ("<THINK>q</think>", ""), (None, ""), ("a\n\nb", "a b")], lambda: T.prediction_text(C("t")))
_cases("edge_ids", _T, [("12\tword", "word"), (" 7 \tx", "x"), ("no number", "no number"), ("12 word", "12 word")], lambda: T.strip_line_number(C("t")))
_cases("edge_document_keys", _T, [("a\tb\tc", "a\tb"), ("a", "a"), ("", "")], lambda: T.document_key(C("t")))
_cases("edge_targets", "w string, r string", [("слво", "слово", "слво -> слово"), ("CORRECT", "x", "CORRECT"), ("x", "CORRECT", "CORRECT")], lambda: T.error_target(C("w"), C("r")))
_cases("edge_difficulty", _T, [("low-1", "low"), ("medium-2", "medium"), ("high-3", "default"), ("", "default")], lambda: T.difficulty(C("t")))
_cases("edge_unpacked", "p struct<en:string,uk:string>", [(("a", "б"), "a|б"), ((None, "б"), "NULL|б")], lambda: _join(F.array(*T.unpack(C("p"), "en", "uk"))))
_cases("edge_passages", "p string, s string", [("text", "stem", "head\n\ntext\n\nstem"), ("", "s", "head\n\n\n\ns")], lambda: T.with_passage("head", C("p"), C("s")))
_OPTIONS = "o map<string,string>"
_ELEVEN = {str(k): chr(97 + k) for k in (10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0)}
_cases("edge_options", _OPTIONS, [(_ELEVEN, "\n".join(f"{k}. {chr(97 + k)}" for k in range(11))), ({"1": "b", "0": "a"}, "0. a\n1. b"), ({"5": "x"}, "5. x")], lambda: T.format_options(C("o")))
_cases("edge_lettered", _OPTIONS, [({"1": "b", "0": "a", "2": "c"}, "А: a\nБ: b\nВ: c"), ({"3": "z"}, "А: z")], lambda: T.format_lettered(C("o")))
_cases("edge_choice_maps", "c array<string>", [(["x", "y"], '{"0":"x","1":"y"}'), (["q"], '{"0":"q"}')], lambda: F.to_json(T.choices_map(C("c"))))

_cases("edge_boxed", _T, [(r"a \boxed{\frac{1}{2}} b", r"\frac{1}{2}"), (r"\boxed{1} \boxed{2}", "2"), (r"\boxed{open", None), ("none", None), (None, None), (r"\boxed{}", "")], lambda: maths.boxed(C("t")))
_cases("edge_unboxed", _T, [(r"x \boxed{\boxed{1}+2} y", "x 1+2 y"), (r"\boxed{open", r"\boxed{open"), ("none", "none"), (r"\boxed{a}\boxed{b}", "ab")], lambda: maths.unboxed(C("t")))
_cases("edge_fractions", _T, [("0.5", r"\frac{1}{2}"), ("x=.5", r"x=\frac{1}{2}"), ("0,25 m", r"\frac{1}{4} m"), ("20.00", "20"), ("[asy]0.5[/asy] 1.5", r"[asy]0.5[/asy] \frac{3}{2}"), ("2  3", "2 3"), ("no", "no"), (r"\$3.50", r"\$\frac{7}{2}")], lambda: maths.fractions(C("t")))
_cases("edge_marks", _T, [("a<<1+<<2>>=3>>b", "ab"), ("<<x", "x"), ("2*3=<<2*3=6>>6", "2*3=6")], lambda: maths.unmarked(C("t")))
_cases("edge_hashes", _T, [("steps #### 1 #### 2 ", "2"), ("whole", "whole"), ("x\n#### 1,000", "1,000")], lambda: maths.after_hashes(C("t")))
_cases("edge_finished", "t string, f string", [("3*<<3*.5=1.5>>0,5 \\boxed{1.5}", " 1.5 ", "3*\\frac{1}{2} \\frac{3}{2}\nAnswer: \\boxed{1.5}")], lambda: maths.finished(C("t"), C("f")))
_cases("edge_solved", "t string, f string", [("it is ANSWER : 2", "9", "it is ANSWER : 2"), ("a\nb\n#### 5", "5", "a\nb\n\nAnswer: 5"), ("plain", "7", "plain\n\nAnswer: 7"), ("plain", None, "plain"), (None, None, "")], lambda: maths.assistant(C("t"), C("f")))
_cases("edge_numbers_at_end", _T, [("x #### 12", "true"), ("x #### -1,5 ", "true"), ("x #### y", "false"), ("12", "false"), (None, "false")], lambda: maths.ends_in_number(C("t")))
_cases("edge_same_numbers", "a string, b string", [("1,000", "1000", "true"), ("$5", "5.0", "true"), (r"\boxed{3}", "3.", "true"), ("x", "y", "false"), (None, "1", "false"), (" a b", "ab", "true")], lambda: evaluate.same_number(C("a"), C("b")))

_cases("edge_breaks", _T, [("aaa\nbbb ccc", "aaa|\nbbb| ccc"), ("abcdefghij", "abcdef|ghij"), ("ab cd ef gh", "ab cd| ef gh"), ("", ""), ("abcdef", "abcdef")], lambda: _join(chunking.split_at_breaks(C("t"), 6)))
_cases("edge_bytes", _T, [("Раз. Два. Три.", "Раз. Два.|Три."), ("One two three four five six. Yes.", "One two three four five six.|Yes."), ("", ""), ("ok", "ok")], lambda: _join(chunking.split_by_bytes(C("t"), 16)))
_cases("edge_blocks", _T, [("short\n\nlong line one\nline two", "short / long line |one|line two"), ("\n\n", " / "), ("A b. C d. E f g h i j k", "A b. C d.|E f g h i |j k")], lambda: F.array_join(F.transform(chunking.split_paragraphs(C("t"), 10), lambda p: F.array_join(p, "|")), " / "))
_cases("edge_budget", _T, [("", "384"), ("x" * 1000, "814"), ("x" * 2000, "1024"), ("x" * 427, "384")], lambda: T.token_budget(C("t")))

_ANSWERS = "a array<struct<marker:string,text:string>>, c array<string>"
_AB = [("А", "Київ"), ("Б", "Львів")]
_cases("edge_answer_letters", _ANSWERS, [(_AB, ["київ!"], "А"), (_AB, ["б"], "Б"), (_AB, ["В"], "В"), (_AB, ["довга відповідь"], ""), (_AB, ["Львів", "Київ"], "А|Б")], lambda: _join(parse.answer_letters(C("a"), C("c"))))
_cases("edge_predicted_letters", "t string, a array<struct<marker:string,text:string>>", [("Відповідь: Б", _AB, "Б"), ("це львів", _AB, "Б"), ("", _AB, None), ("нічого", _AB, None), (None, _AB, None)], lambda: parse.predicted_letter(C("t"), C("a")))
_ASK = "Питання?\nА: раз\nБ: два"
_cases("edge_lettered_questions", "u string, r string", [(_ASK, "Б", '{"question":"Питання?","possible_answers":{"0":"раз","1":"два"},"correct_answer_num":"1"}'), (_ASK, "Думаю. Відповідь: А", '{"question":"Питання?","possible_answers":{"0":"раз","1":"два"},"correct_answer_num":"0"}'), (_ASK, "Д", None), ("без варіантів", "А", None), (None, "А", None)], lambda: F.to_json(parse.lettered_question(C("u"), C("r"))))
_cases("edge_error_pairs", _T, [("слво -> слово", "слво|слово"), ("CORRECT", "CORRECT|CORRECT"), ("помилки немає", "CORRECT|CORRECT"), ("«хай» «нехай»", "хай|нехай"), ("перше друге третє", "перше|друге"), ("одне", "NULL|NULL"), ("", "NULL|NULL"), ("Неправильне слово: а, виправлення: б", "а|б"), ("incorrect word: a, correction: b", "CORRECT|CORRECT")], lambda: _join(F.array(parse.error_pair(C("t"))["wrong"], parse.error_pair(C("t"))["right"])))
_cases("edge_checked_pairs", "w string, r string", [(None, "x", "NO_OUTPUT|x"), ("CORRECT", None, "CORRECT|CORRECT"), ("a", "b", "a|b"), (None, None, "NO_OUTPUT|NO_OUTPUT")], lambda: _join(F.array(parse.checked_pair(C("w"), C("r"))["wrong"], parse.checked_pair(C("w"), C("r"))["right"])))
_cases("edge_literals", _T, [("['a', \"b\"]", "a|b"), ('["x"]', "x"), ("[1, 2]", "1|2"), ("plain", "plain"), ("", ""), (None, "")], lambda: _join(parse.literal_list(C("t"))))
_cases("edge_messages", _T, [("[{'role': 'user', 'content': 'x'}]", '[{"role":"user","content":"x"}]'), ("[]", "[]"), ("nonsense", None), (None, None)], lambda: F.to_json(parse.messages(C("t"))))

_P = "a string, b string"
_LONG, _LANG = "a" * 30 + " b c d e", "б" * 30 + " в г д е"
_cases("edge_long_enough", _P, [(_LONG, _LANG, "true"), ("x" * 29, _LANG, "false"), ("a" * 40, _LANG, "false"), (None, _LANG, "false"), (" " * 40, _LANG, "false")], lambda: F.coalesce(filters.long_enough(C("a"), C("b")), F.lit(False)))
_cases("edge_mined", "l string, s string, t string", [("1.17", "0.95", "0.98", "true"), ("1.16", "1", "1", "false"), ("x", "1", "1", "false"), (None, "1", "1", "false"), ("2", "0.94", "1", "false"), ("2", "1", "0.97", "false")], lambda: filters.mined(C("l"), C("s"), C("t")))
_cases("edge_mined_strictly", "l string, s string, t string", [("1.17", "0.97", "0.99", "true"), ("1.2", "1.01", "1.01", "true"), ("1.2", "1.02", "1", "false"), ("1.2", "0.96", "1", "false"), ("1.2", None, "1", "false")], lambda: filters.mined(C("l"), C("s"), C("t"), 1.17, **filters.STRICT))
_cases("edge_unscored", "l double", [(None, "true"), (1.2, "true"), (1.1999, "false")], lambda: filters.laser_or_unscored(C("l")))
_cases("edge_prose", _T, [("Добре слово", "true"), ("Good word", "false"), ("12345 слово 678", "false"), ("", "false"), ("!!!", "false"), ("слово abc", "true")], lambda: filters.clean_prose(C("t")))
_cases("edge_dialogue", _T, [("— так", "true"), ("- так", "true"), ("«Так».", "true"), ("“Так”!", "true"), ("так — ні", "false"), ("", "false"), ("«Так», сказав", "false")], lambda: filters.dialogue(C("t")))
_cases("edge_chunks", "n int, s array<string>", [(240, ["слово"], "true"), (239, ["слово"], "false"), (840, ["слово"], "true"), (841, ["слово"], "false"), (300, ["— так", "слово", "слово"], "false"), (300, ["— так", "а", "а", "а"], "true")], lambda: filters.chunk_kept(F.array_join(F.array_repeat(F.lit("слово"), C("n")), " "), C("s")))
_cases("edge_windows", _P, [("x" * 80, "y" * 80, "true"), ("x" * 79, "y" * 80, "false"), ("x" * 80, "y" * 4001, "false")], lambda: filters.char_window(C("a"), C("b"), 80, 4000))
_cases("edge_choices", _T, [("довге речення тут", "true"), ("коротко", "false"), ("english words here", "false"), ("  абвг 123456789 ", "true")], lambda: filters.usable_choice(C("t")))
_cases("edge_single_errors", "n int", [(0, "true"), (1, "true"), (2, "false")], lambda: filters.single_error(C("n")))
_cases("edge_one_correct", _ANSWERS, [(_AB, ["А"], "true"), (_AB, ["А", "Б"], "false"), (_AB, ["В"], "false"), ([], ["А"], "false")], lambda: F.coalesce(filters.one_correct(C("a"), C("c")), F.lit(False)))
_cases("edge_numbered_questions", "n string, a array<string>, q string", [("1", ["x", "y"], "q", "true"), ("3", ["x", "y"], "q", "false"), ("0", ["x", "y"], "q", "false"), ("z", ["x"], "q", "false"), ("1", ["x", " "], "q", "false"), ("1", ["x"], " ", "false")], lambda: F.coalesce(filters.numbered_question(C("n"), C("a"), C("q")), F.lit(False)))
_cases("edge_keyed_questions", "k string, c array<string>", [("x", ["x", "y "], "true"), ("y", [" y", "x"], "true"), ("a", ["x", "y"], "false"), ("x", ["x", ""], "false"), (None, ["x", "y"], "false"), ("x", list("xyzuvw"), "false")], lambda: F.coalesce(filters.keyed_question(C("k"), C("c")), F.lit(False)))
_cases("edge_pairs_of", "p string, s string", [("en_uk", "x", "true"), (None, "x", "true"), ("cs_uk", "x", "false")], lambda: filters.of_pair(C("p"), C("s")))
_cases("edge_markers", "p string, s string", [("en_uk", "from Czech into", "true"), ("en_uk", "from English", "false")], lambda: filters.of_pair(C("p"), C("s"), marker="Czech"))
_cases("edge_maths_rows", "q string, a string, d string", [("q", "a", "low", "true"), ("q", " ", "low", "false"), (None, "a", "low", "false"), ("q", "a", "high", "false")], lambda: filters.maths_row(C("q"), C("a"), C("d"), "low"))
_cases("edge_translated_rows", "q string, o map<string,string>", [("q", {"0": "x"}, "true"), ("", {"0": "x"}, "false"), ("q", {}, "false"), ("q", None, "false")], lambda: filters.translated_row(C("q"), C("o")))
_cases("edge_latex", _T, [(r"\frac{1}{2}", "true"), (r"\фрак{1}", "false"), (r"x \тексту{y}", "false"), (r"\ж", "false"), ("просто", "true")], lambda: filters.sound_latex(C("t")))
_cases("edge_subjects", _T, [("history", "true"), ("maths", "false")], lambda: filters.subjects(C("t"), ["history"]))
_EN, _UK = "He wrote 1,234 letters to Ann.", "Він написав 1,234 листи до Анни."
_cases("edge_entities", _P, [(_EN, _UK, "pass"), (_EN, "Він написав листи до Анни.", "large_number"), ("1 a 2 a 3 a 4 a 5 a 6 a 7 a 8", "1", "number_count"), ("see http://a.b now", "дивись зараз", "url"), ("5 % 6 % 7 %", "5 і 6 і 7 %", "percent"), ("10 20", "10 20", "pass")], lambda: F.coalesce(clean.entity(C("a"), C("b"))["reason"], F.lit("pass")))
_COPIED = "q w e r t y u i o p a s d f g h j k l z"
_cases("edge_copies", _P, [("a" * 100, "б" * 50, "char_ratio_oob"), ("a" * 100, "б" * 51, "pass"), ("a" * 100, "б" * 81 + "z" * 20, "pass"), ("a" * 100, "б" * 79 + "z" * 21, "high_latin_in_target"), ("a" * 88 + " http://x.y", "б" * 79 + "z" * 21, "pass"), ("а б в г", "а б в д", "high_token_overlap"), ("а б в", "а б в", "pass")], lambda: F.coalesce(clean.copied(C("a"), C("b"))["reason"], F.lit("pass")))
_cases("edge_structural", _P, [("x" * 9, "y" * 9, "src_too_short"), ("x" * 10, "y" * 10, "pass"), ("x" * 1001, "y" * 900, "src_too_long"), ("x" * 10, "y" * 4, "tgt_too_short"), ("x" * 1000, "y" * 1201, "tgt_too_long"), ("x" * 22, "y" * 10, "pass"), ("x" * 23, "y" * 10, "char_ratio"), ("a b c d e f g h i", "abcdefghi jklmnop", "word_ratio")], lambda: F.coalesce(clean.structural(C("a"), C("b"))["reason"], F.lit("pass")))

_cases("edge_differences", _P, [("він йде", "він йде", "CORRECT|CORRECT|0"), ("він йти додому", "він йде додому", "йти|йде|1"), ("він додому", "він йде додому", "йде|йде|1"), ("він, йде", "він йде", ",|,|1"), (" x ", "x", "CORRECT|CORRECT|0"), ("a b c d", "a x c y", "b|x|2")], lambda: F.concat_ws("|", errors.differing(C("a"), C("b"))["wrong"], errors.differing(C("a"), C("b"))["right"], errors.differing(C("a"), C("b"))["regions"]))
_cases("edge_typos", "t string, k int", [("і я", 1, "і я|CORRECT|CORRECT"), ("так ні", 2, "так ні|CORRECT|CORRECT"), ("", 3, "|CORRECT|CORRECT")], lambda: F.concat_ws("|", *(errors.injected(C("t"), C("k"), F.lit(False))[x] for x in ("input", "wrong", "right"))))
_cases("edge_cosines", "a array<double>, b array<double>", [([1.0, 0.0], [1.0, 0.0], "1.0"), ([1.0, 0.0], [0.0, 2.0], "0.0"), ([3.0, 4.0], [6.0, 8.0], "1.0"), ([0.0], [1.0], None)], lambda: F.round(clean.cosine(C("a"), C("b")), 6))
_cases("edge_composites", "a double, b double", [(1.0, 0.0, "0.7"), (1.0, None, "1.0"), (None, 0.5, "0.5"), (None, None, "0.0")], lambda: F.round(clean.estimated({"uk_quality": C("a"), "structural": C("b")})["score"], 6))
_cases("edge_languages", _P, [("hello", "привіт", "pass"), ("привіт", "привіт", "source_language"), ("hello", "hello", "target_language"), ("привіт", "hello", "source_language")], lambda: F.coalesce(clean.language(C("a"), C("b"), "en-uk", _guess)["reason"], F.lit("pass")))
_cases("edge_bloom", "n int, p double", [(50_000_000, 0.001, "718879378|10"), (1000, 0.01, "9585|7")], lambda: F.when(C("n") == 1000, F.concat_ws("|", *map(F.lit, dedup.bloom_size(1000, 0.01)))).otherwise(F.concat_ws("|", *map(F.lit, dedup.bloom_size(50_000_000, 0.001)))))
_cases("edge_signatures", "a array<int>, b array<int>", [([1, 2, 3, 4], [1, 2, 3, 4], "1.0"), ([1, 2, 3, 4], [1, 0, 3, 0], "0.5")], lambda: dedup.resemblance(C("a"), C("b")))
_cases("edge_orders", "n int", [(1, "true"), (2, "true"), (4, "true")], lambda: _reordered(C("n")))
_cases("edge_reasoned", "r string, i boolean", [("думка", True, "q\n\nдумка\n\no=>Б"), ("думка", False, "q\n\no=>думка\nВідповідь: Б"), ("думка. Відповідь: Б", False, "q\n\no=>думка. Відповідь: Б"), ("Відповідь: А", False, "q\n\no=>Відповідь: А\nВідповідь: Б")], lambda: _reasoned())
_cases("edge_numbers", "n int, d int", [(7, 5, "sid-00007"), (123456, 5, "sid-123456"), (0, 6, "sid-000000")], lambda: F.when(C("d") == 5, records.numbered("sid-", C("n"))).otherwise(records.numbered("sid-", C("n"), 6)))


def _guess(texts: list[str]) -> list[tuple[str, float]]:
    return [("uk" if any("а" <= c <= "я" for c in t) else "en", 0.99) for t in texts]


def _reordered(n: Column) -> Column:
    """Whether another order has the same answers, and differs if it can."""
    answers = F.slice(F.array(*(F.struct(F.lit(m).alias("marker"), F.lit(t).alias("text")) for m, t in zip("АБВГ", "wxyz"))), 1, n)
    order = records.another_order(answers, F.col("p_partkey"))
    return (F.array_sort(order) == F.sequence(F.lit(0), n - 1)) & ((n == 1) | (order != F.sequence(F.lit(0), n - 1)))


def _reasoned() -> Column:
    chat = records.reasoned(F.lit("q"), C("r"), F.lit("o"), F.lit("Б"), "s", C("i"))
    return F.concat(chat[1]["content"], F.lit("=>"), chat[2]["content"])
