import pytest

from tickloom.llm.quality import common_words, layout, not_prose, phrase_coverage, text_layout, text_statistics

PROSE = {
    "plain": "The second shift moved the ledger before dawn, and nobody was told why it had to be so. We saw seven rows in every file.",
    "wrapped": "The second shift\nmoved the ledger\nbefore dawn, and\nnobody was told\nwhy it had to be\nso. We saw seven\nrows in every file.",
    "typed": "the second shift moved the ledger before dawn and nobody was told why it had to be so we saw seven rows in every file",
    "upper": "THE SECOND SHIFT MOVED THE LEDGER BEFORE DAWN, AND NOBODY WAS TOLD WHY IT HAD TO BE SO.",
    "items": "- The second shift moved the ledger before dawn, and nobody was told.\n- We saw seven rows in every file of the archive after that.",
    "german": "Der Bericht ist nicht fertig, weil die Nachtschicht den Plan noch nicht geprüft hat und niemand es wusste.",
    "spanish": "El informe no está listo porque el turno de noche no revisó el plan y nadie dijo que fuera urgente.",
}
#: Languages of which no word is listed anywhere.
PROSE |= {
    "italian": "Il registro è stato spostato prima dell'alba e nessuno sapeva perché. Abbiamo visto sette righe in ogni file del magazzino.",
    "italian typed": "il registro è stato spostato prima dell'alba e nessuno sapeva perché abbiamo visto sette righe in ogni file del magazzino",
    "polish": "Wszystkie wpisy przeniesiono przed świtem i nikt nie wiedział, dlaczego tak się stało. Znaleźliśmy siedem wierszy w każdym pliku.",
    "finnish": "Yövuoro siirsi pääkirjan ennen aamunkoittoa, eikä kukaan tiennyt miksi. Näimme seitsemän riviä jokaisessa tiedostossa.",
    "russian": "Ночная смена перенесла журнал до рассвета, и никто не знал, почему так вышло. Мы увидели семь строк в каждом файле.",
    "greek": "Η νυχτερινή βάρδια μετέφερε το βιβλίο πριν από την αυγή και κανείς δεν ήξερε γιατί. Είδαμε επτά γραμμές σε κάθε αρχείο.",
    "arabic": "نقلت المناوبة الليلية السجل قبل الفجر ولم يعرف أحد السبب. رأينا سبعة أسطر في كل ملف.",
    "hindi": "रात की पाली ने भोर से पहले बही को हटा दिया और किसी को नहीं बताया गया। हमने हर फ़ाइल में सात पंक्तियाँ देखीं।",
    "chinese": "夜班在黎明前移动了账本，没有人知道为什么。我们在每个文件中看到了七行数据，但是谁也没有解释。",
    "japanese": "夜勤は夜明け前に帳簿を移動しましたが、誰も理由を知りませんでした。すべてのファイルに七行がありました。",
}
JUNK = {
    "boilerplate": "\n".join(["The second shift moved the ledger before dawn, and nobody was told why it had to be so."] * 200),
    "boilerplate paragraphs": "\n\n".join(["All rights are kept by the owner.\nNothing in this notice is advice to trade."] * 40),
    "keyboard": "awdjuid rjohkueqtauu z;qk dkfoqjqwe'hgug hleal'ktfuu oroo'oo gqsuweqhwjgoi qfuzhjo k;d'q;ll 'jdl fpptroaat zzsroru qoal spkjsrarkogfdf",
    "polish list": "spokojny rejestr\nwczesna kolejka\nwąski arkusz cenowy\nzapasowy dziennik\nszybki podgląd",
    "leaders": "Settlement Flag ............................... 3\nReplay Report ................................. 5\nEntry Listing ................................. 7",
    "settings": "swing_slot: 0.103\nreserve_record: 4725\nledger_calendar: true\nbootstrap_slot: stale",
    "list": "- quiet ledger\n- early archive queue\n- narrow price plan\n- spare swing log",
    "numbered": "1. Quiet ledger\n2. Early archive queue\n3. Narrow price plan",
    "csv": "a_id,b_px,c\nX:1,12.5,quiet\nX:2,13.5,narrow\nX:3,,loose",
    "table": "| a | b |\n|---|---|\n| X:1 | 12.5 |\n| X:2 | 13.5 |",
    "hashes": "5f0e1d2c3b4a59687766554433221100\n00112233445566778899aabbccddeeff",
    "menu": "Home | Help | More | Next | Back | Close | Print | Terms",
    "phrase": "plan de pagos plan de pagos plan de pagos plan de pagos plan de pagos plan de pagos",
    "symbols": "@|%<}]>]![#_&$/|--%{#!~%]$]\n=~}{?-#<_!/",
    "spanish items": "* siguió plan de pagos\n* midió registro diario\n* detuvo libro de órdenes\n* revisó el plan de pagos",
}


@pytest.mark.parametrize("name", PROSE)
def test_prose(name):
    assert layout(PROSE[name])[3] > 0.9


@pytest.mark.parametrize("name", JUNK)
def test_junk(name):
    assert layout(JUNK[name])[3] < 0.1


def test_repetition():
    assert phrase_coverage("a b c a b c a b c".split()) == 1.0 and phrase_coverage("a b c d e f g".split()) == 0.0 and phrase_coverage(["a"]) == 0.0
    line, para, _, _ = layout("same\nother\nsame\n\nxx\n\nxx")
    assert line == pytest.approx((4 + 2) / (4 + 5 + 4 + 2 + 2)) and para == pytest.approx(2 / (13 + 2 + 2))
    assert layout(None) == layout("") == layout(" \n ") == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("text", ["the log\n" * 200, "plan de rasgos\n" * 200, "\n\n".join(["the log of the plan"] * 200), "\n".join(f"the log {k}" for k in range(200)), "\n".join(["we saw it", "nobody was there", "this is the plan", "it had to be so"][k * k // 3 % 4] for k in range(200))])
def test_short_repeated_lines_are_no_prose(text):
    assert layout(text)[3] < 0.1


@pytest.mark.parametrize("name", PROSE)
def test_prose_filed_again_in_a_text_or_word_by_word_stays_prose(name):
    assert layout("\n\n".join([PROSE[name]] * 5))[3] > 0.9
    if name != "items":
        assert layout(PROSE[name].replace(" ", "\n"))[3] > 0.9


def test_coverage_counts_characters():
    twice = "Von acht Fällen kamen zwei aus dem Auszahlungsplan, der Rest aus dem Auszahlungsplan, und der Kerzenstrom blieb teuer."
    assert phrase_coverage([x.strip(",.").lower() for x in twice.split()]) > 0.4 and layout(twice)[3] > 0.9
    assert phrase_coverage("a b c a b c lengthy words here".split()) == pytest.approx(6 / (6 + 16))


def test_whole_long_text():
    junk = "\n".join(f"{k:040x}" for k in range(3000))
    assert layout(PROSE["plain"] + "\n" + junk)[3] < 0.01 and layout(junk + "\n" + (PROSE["plain"] + "\n") * 3000)[3] > 0.6


def test_frames(spark):
    rows = [(1, PROSE["plain"], "k"), (2, JUNK["csv"], "k"), (3, None, "k"), (4, "", "k"), (5, "  \n", None), (2, JUNK["csv"], "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, prose_share string")
    assert sorted(r[0] for r in not_prose(df).collect()) == [2, 2]
    assert text_layout(df).columns == ["doc_id", "text", "duplicate_line_share", "duplicate_paragraph_share", "phrase_coverage", "prose_share"]
    s = {r["doc_id"]: r for r in text_statistics(df).collect()}
    assert s[3]["n_words"] == 0 and s[3]["mean_word_length"] is None and s[4]["line_count"] == 0
    assert s[1]["n_words"] == 25 and s[1]["end_mark_share"] == 1.0
    assert not_prose(df.limit(0)).count() == 0


def test_common_words_are_learnt(spark):
    df = spark.createDataFrame([(k, f"Il file {chr(97 + k)} il resto" if k % 2 else f"the x{chr(97 + k)}", None) for k in range(20)] + [(99, None, None)], "doc_id bigint, text string, word string")
    assert common_words(df, share=0.4) == ["file", "il", "resto", "the"]
    s = {r["doc_id"]: r for r in text_statistics(df, common=["il"]).collect()}
    assert s[1]["common_word_share"] == 0.4 and s[0]["common_word_share"] == 0.0 and s[99]["common_word_share"] is None
    assert common_words(df.limit(0)) == [] and text_statistics(df.limit(0)).count() == 0
