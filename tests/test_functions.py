"""Text, mathematics, parsing and chunking against plain Python."""

import hashlib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunking, maths, parse
from corpusloom.functions import text as T
from corpusloom.operators import clean, errors, filters


def one(spark, column, **values):
    """The value of a column over one row."""
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, (list, dict)) else value(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).collect()[0].x


def value(v):
    if isinstance(v, dict):
        return F.create_map(*(F.lit(x) for kv in v.items() for x in kv))
    return F.array(*(F.struct(*(F.lit(b).alias(a) for a, b in x.items())) if isinstance(x, dict) else F.lit(x) for x in v))


C = F.col


@pytest.mark.parametrize("text, expected", [(None, ""), ("", ""), ("​a­ \t b\u0007c", "a bc"), ("é ʼ’", "é ''"), (" a\n b ", "a\n b"), ("a b", "a b")])
def test_unicode_clean(spark, text, expected):
    assert one(spark, T.unicode_clean(C("t")), t=text) == expected


def test_text_functions(spark):
    assert one(spark, T.question_key(C("t")), t="  Хто — ВІН?! a_1") == "хто він a_1"
    assert one(spark, T.prediction_text(C("t")), t="<think>a\nb</THINK> \"'so  it\n is'\" ") == "so it is"
    assert one(spark, T.word_count(C("t")), t="  a b  c ") == 3 and one(spark, T.word_count(C("t")), t=None) == 0
    assert sorted(one(spark, T.char_ngrams(C("t")), t="ABCDEFabcde")) == sorted({"abcdef"[i : i + 5] for i in range(2)} | {"abcdefabcde"[i : i + 5] for i in range(7)})
    assert one(spark, T.strip_line_number(C("t")), t=" 12\tx") == "x" and one(spark, T.document_key(C("t")), t="a\tb\tc") == "a\tb"
    assert one(spark, T.strip_fences(C("t")), t="```json\n{}\n```") == "{}"
    options = {"10": "c", "2": "b", "0": "a"}
    assert one(spark, T.format_options(C("o")), o=options) == "0. a\n2. b\n10. c"
    assert one(spark, T.format_lettered(C("o")), o=options) == "А: a\nБ: b\nВ: c"
    assert [tuple(x) for x in one(spark, T.lettered_answers(C("o")), o=options)] == [("А", "a"), ("Б", "b"), ("В", "c")]
    assert one(spark, T.choices_map(C("o")), o=["x", "y"]) == {"0": "x", "1": "y"}
    assert one(spark, T.error_target(C("a"), C("b")), a="x", b="y") == "x -> y" and one(spark, T.error_target(C("a"), C("b")), a="CORRECT", b="y") == "CORRECT"
    assert [one(spark, T.token_budget(C("t")), t="x" * n) for n in (0, 600, 5000)] == [384, 514, 1024]
    assert one(spark, T.peel_quotes(C("t")), t=" «Так» ") == "Так" and [one(spark, T.difficulty(C("t")), t=x) for x in ("low-3", "medium-1", "high-2")] == ["low", "medium", "default"]
    assert one(spark, T.subject(C("t"), {"a": "x|y", "b": "z"}, "none"), t="xz") == "a" and one(spark, T.subject(C("t"), {"a": "x", "b": "z"}, "none"), t="q") == "none"
    assert one(spark, T.ukrainian_letters(C("t")), t="Їжак ab") == 4 and one(spark, T.first_of(C("a"), C("b")), a="", b="y") == "y"


def test_md5_split(spark):
    for t in ("", "abc", "питання", "x" * 1000):
        assert one(spark, T.in_share(C("t")), t=t) == (int.from_bytes(hashlib.md5(t.encode()).digest(), "big") % 10 in range(7))


def test_maths(spark):
    assert maths.box_content(r"a \boxed{1} b \boxed{\frac{1}{2}} c") == r"\frac{1}{2}"
    assert maths.box_content("none") is maths.box_content(r"\boxed{open") is maths.box_content(None) is None
    assert maths.without_boxes(r"\boxed{a{b}} \boxed{\boxed{c}} \boxed{d") == r"a{b} c \boxed{d"
    assert maths.without_marks("a<<1<<2>>3>>b>>") == "ab"
    assert maths.to_fractions("x=.5, 20.00 1,25 1.2.3 [asy]0.5[/asy]") == r"x=\frac{1}{2}, 20 \frac{5}{4} \frac{6}{5}.3 [asy]0.5[/asy]"
    assert one(spark, maths.finished(C("t"), C("f")), t=r"<<1+1=2>> so  \boxed{0.5}", f=" 2 ") == "so \\frac{1}{2}\nAnswer: \\boxed{2}"
    for t, e in (("x Answer: 1 answer : 2 ", "2"), ("a #### 3 #### 4", "4"), (" all ", "all"), (None, "")):
        assert one(spark, maths.final_answer(C("t")), t=t) == e
    assert one(spark, maths.simple_box(C("t")), t=r"\boxed{1} \boxed{2}") == "2" and one(spark, maths.after_hashes(C("t")), t="a#### 7 ") == "7"
    assert one(spark, maths.assistant(C("t"), C("f")), t="s1\n#### 5", f="5") == "s1\n\nAnswer: 5"
    assert one(spark, maths.assistant(C("t"), C("f")), t="s answer: 5", f="6") == "s answer: 5" and one(spark, maths.assistant(C("t"), C("f")), t="s", f=None) == "s"
    assert one(spark, maths.ends_in_number(C("t")), t="so #### -1,200.5 ") and not one(spark, maths.ends_in_number(C("t")), t="#### x")


@pytest.mark.parametrize("said, expected", [("Answer: 2", "2"), ("відповідь - 1", "1"), ("3) because", None), ("it is 0 then", "0"), ("Answer: 9 but 1", None), ("surely KYIV!", "0"), ("nothing", None), (None, None)])
def test_choice(spark, said, expected):
    assert one(spark, parse.choice(C("p"), C("o")), p=said, o={"0": "Kyiv", "1": "Lviv", "2": "Odesa"}) == expected


def test_error_pairs():
    read = parse.read_error_pair
    assert read("Немає помилки", False) == ("CORRECT", "CORRECT") == read("incorrect word: a", False)
    assert read("incorrect word: кит, correct word: кіт", True) == ("кит", "кіт") == read("помилкове слово: кит, виправлення: кіт", False)
    assert read("кит -> кіт", False) == ("кит", "кіт") and read("«кит» та «кіт»", False) == ("кит", "кіт") and read("кит кіт", False) == ("кит", "кіт")
    assert read("", False) == (None, None) and read("correct.", True) == ("CORRECT", "CORRECT")


def test_parsers(spark):
    assert tuple(one(spark, parse.checked_pair(C("a"), C("b")), a=None, b="CORRECT")) == ("CORRECT", "CORRECT")
    assert tuple(one(spark, parse.checked_pair(C("a"), C("b")), a="x", b=None)) == ("x", "NO_OUTPUT")
    options = [{"marker": "А", "text": "Київ"}, {"marker": "Б", "text": "Львів"}]
    assert one(spark, parse.answer_letters(C("o"), C("c")), o=options, c=["львів!"]) == ["Б"] and one(spark, parse.answer_letters(C("o"), C("c")), o=options, c=["zz", "long one"]) == ["ZZ"]
    assert one(spark, parse.predicted_letter(C("a"), C("o")), a="варіант б", o=options) == "Б" and one(spark, parse.predicted_letter(C("a"), C("o")), a="мабуть київ", o=options) == "А"
    assert one(spark, parse.predicted_letter(C("a"), C("o")), a="", o=options) is None
    assert parse.read_lettered("Хто?\nА: я\nБ: ти", "Б") == ("Хто?", {"0": "я", "1": "ти"}, "1")
    assert parse.read_lettered("Хто?\nА: я", "міркую\nВідповідь: а") is None and parse.read_lettered("Хто?", "А") is None and parse.read_lettered("Q\nА: x", "В") is None
    assert one(spark, parse.literal_list(C("t")), t="['a', 1]") == ["a", "1"] and one(spark, parse.literal_list(C("t")), t=None) == []
    assert [tuple(m) for m in one(spark, parse.messages(C("t")), t="[{'role': 'user', 'content': 'hi'}]")] == [("user", "hi")] and one(spark, parse.messages(C("t")), t="x") is None


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n", max_size=80), st.integers(3, 20))
def test_pieces_lose_nothing(text, limit):
    assert "".join(chunking.by_breaks(text, limit)) == text and all(len(p) <= limit for p in chunking.by_breaks(text, limit))
    flat = [p for ps in chunking.paragraph_pieces(text, limit) for p in ps]
    assert all(len(p) <= limit for p in flat) and "".join("".join(flat).split()) == "".join(text.split())
    assert "".join("".join(chunking.by_bytes(text, limit)).split()) == "".join(text.split())


def test_pieces_go_back_together(spark):
    texts = ["one\n\ntwo. three\n\n\n\nfour", "", "x" * 25]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    whole = {r.id: r.text for r in chunking.from_pieces(chunking.to_pieces(docs, "id", "text", 100), "id").collect()}
    assert whole == dict(enumerate(texts))
    assert [r.piece for r in chunking.to_pieces(docs, "id", "text", 10).where("id = 2").orderBy("position").collect()] == ["x" * 10, "x" * 10, "x" * 5]


def test_typos():
    rng = random.Random(1)
    for k in range(200):
        sentence = " ".join(rng.choices(["Сьогодні", "гарна", "погода", "надворі", "дощ", "мовчання"], k=6))
        made = errors.inject(sentence, str(k))
        if made:
            out, wrong, right = made
            assert out.count(wrong) == 1 and wrong != right and out.replace(wrong, right) in (sentence, out.replace(wrong, right)) and sentence != out
            assert errors.inject(sentence, str(k)) == made
    assert errors.inject("дощ iде", "k") is None and errors.candidates("cat") == []
    assert {f.__name__ for f in errors.STRATEGIES} == {"swap", "drop", "double", "substitute", "homoglyph"}


@pytest.mark.parametrize("a, b, expected", [("я мати дім", "я маю дім", ("мати", "маю", 1)), ("a", " a ", ("CORRECT", "CORRECT", 0)), ("a b", "a", ("b", "b", 1)), ("так.", "так!", (".", "!", 1)), ("a b c", "x b y", ("a", "x", 2)), (None, "", ("CORRECT", "CORRECT", 0))])
def test_differences(a, b, expected):
    assert errors.difference(a, b) == expected


def test_composition_equals_python(spark):
    texts = ["é", "Å", "й", "plain", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.x for r in docs.select("i", T.nfc(C("t")).alias("x")).collect()} == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_character_is_composed(spark):
    """And no long class of characters is tried at every place to find out whether there is something to compose."""
    every = ["a" + chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(every[i : i + 50]) for i in range(0, len(every), 50)] + ["e\u0301", "\u1112\u1161\u11ab", "\u0061\u0323\u0302", "\u212b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfc(C("t")).alias("c")).collect()
    assert all(r.c == unicodedata.normalize("NFC", r.t) for r in got) and len(got) == len(texts)
    assert len(plan(spark.createDataFrame([("x",)], "t string").repartition(1).select(T.nfc(C("t"))))) < 1000


def test_letters_are_counted_in_every_character(spark):
    """As in lower(), which isn't called: it is slow beyond ASCII. Classes are counted without a text for each match."""
    every = [chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(every[i : i + 100]) for i in range(0, len(every), 100)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    counted = df.select("t", T.ukrainian_letters(C("t")).alias("n"), T.count_of(C("t"), r"\p{L}\p{N}_").alias("w"), F.regexp_count("t", F.lit(r"[\p{L}\p{N}_]")).alias("e"))
    assert all(r.n == sum(x in T.UKRAINIAN for x in r.t.lower()) and r.w == r.e for r in counted.collect())
    used = plan(df.select(T.ukrainian_letters(C("t")), filters.clean_prose(C("t")), filters.usable_choice(C("t")), clean.uk_quality(C("t"))))
    assert "lower(" not in used and "[\\p{L}\\p{N}_], 0)" not in used


def test_pieces_go_on_in_small_batches(spark, monkeypatch):
    """A worker holds some texts, not ten thousand, and sends their pieces as they come."""
    texts = ["\n\n".join("слово " * (i % 7) + "x" * (i % 30) for _ in range(i % 5)) for i in range(60)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    for batch in (chunking.BATCH, (3, 20)):
        monkeypatch.setattr(chunking, "BATCH", batch)
        got = {}
        for r in chunking.to_pieces(docs, "id", "t", 12).collect():
            got.setdefault(r.id, {}).setdefault(r.paragraph, {})[r.position] = r.piece
        assert {i: [[p[k] for k in sorted(p)] if None not in p else [] for _, p in sorted(ps.items())] for i, ps in got.items()} == {i: chunking.paragraph_pieces(t, 12) for i, t in enumerate(texts)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
