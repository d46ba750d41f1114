import pytest

from loamdex.llm import encoding as E

INTACT = ["Größe, déjà vu — “naïve” … 90 °C", "Если очередь закрыта, запись ждёт", "├── a\n│   └── b", "A lone � in x", "Reminder: “Ã©” in a index", "printed `Ã¼` instead of ü", "SÃO e MÃO DE OBRA", "příkaz ještě běží", "l’été, d’où", "画面をすぐに更新し", "", None, "plain ascii"]
TEXTS = ["Größe und Übersicht ändern — “Prüfsumme” …", "Если очередь закрыта, запись ждёт", "L’état passe à « terminé ».", "Następnie źródło łączy się", "请先备份路径，然后重建"]


@pytest.mark.parametrize("text", INTACT)
def test_intact(text):
    assert E.examine(text, None) is None


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850"])
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(page, text):
    table = E._page("cp1252" if page == "latin-1" else page) if page != "latin-1" else {b: chr(b) for b in range(128, 256)}
    bad = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    state, _, _, out = E.examine(bad, None)
    assert out == text and state == "restored"


def test_twice_and_part():
    once = "naÃ¯ve â€œxâ€\x9d"
    twice = "".join(chr(b) if b < 128 else E._page("cp1252")[b] for b in once.encode())
    assert E.examine(twice, None)[3] == "naïve “x”"
    assert E.examine("Größe bleibt. RÃ©sumÃ© hier.", None)[3] == "Größe bleibt. Résumé hier."
    assert E.examine("fen�tre tr�s", None)[0] == "lost"


@pytest.mark.parametrize("page", E.PAGES)
def test_many_layers(page):
    text = bad = "Die Größe der Übersicht hängt von geänderten Einträgen ab, die nächste „Prüfung“ läuft."
    for _ in range(5):
        bad = "".join(E._page(page)[b] if b > 127 else chr(b) for b in bad.encode())
        assert E.restore_multibyte(bad)[0] == text


def test_table(spark):
    clean = [(i, "Größe und Läufe für Prüfsumme häufig", "x") for i in range(60)]
    df = spark.createDataFrame(clean + [(100, "Gr÷▀e und LΣufe fⁿr Prⁿfsumme hΣufig", "x"), (101, "naÃ¯ve RÃ©sumÃ©", "x"), (102, None, "x"), (103, "", "x"), (101, "naÃ¯ve RÃ©sumÃ©", "x")], "doc_id bigint, text string, state string")
    rows = {r["doc_id"]: r for r in E.damaged(df).collect()}
    assert set(rows) == {100, 101} and rows[100]["text"] == "Größe und Läufe für Prüfsumme häufig"
    assert E.found(E.damaged(df)).count() == 2 and E.damaged(df.limit(0)).count() == 0


def test_whole_source_damaged_alike(spark):
    nouns = ["Größe", "Läufe", "Prüfsumme", "Schlüssel", "Übersicht", "Änderung", "Lösung", "Maß"]
    german = [f"{a} und {b} für {c} häufig {i}" for i, (a, b, c) in enumerate(zip(nouns * 15, nouns[1:] * 15, nouns[2:] * 15))]
    russian = [f"Если очередь {w} закрыта, запись ждёт {i}" for i, w in enumerate(["записей", "чтения", "замен", "сборки"] * 30)]
    page = lambda text, right, wrong: "".join(c if c < "\x80" else E._page(wrong)[c.encode(right)[0]] for c in text)
    bad = {"cp1251": [page(x, "cp1251", "cp1252") for x in russian[:40]], "mac": [page(x, "mac_roman", "cp1252") for x in german[:40]]}
    good = german[40:] + russian[40:]
    texts = [*bad["cp1251"], *bad["mac"], *good, *[bad["mac"][0]] * 50]
    rows = {r["doc_id"]: r["text"] for r in E.damaged(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert set(rows) == {*range(80), *range(80 + len(good), len(texts))}
    assert [rows[i] for i in range(80)] == russian[:40] + german[:40]


def test_one_damaged_character(spark):
    clean = [f"Eine Lösung im Café {i}" for i in range(20)] + [f"Škoda a loď {i}" for i in range(3)]
    bad = ["Keine Lšsung", "Im Caf‚ hier", "Ein Caf\x8e"]
    # A rare character without a strong other reading, or one that joins words, is left alone.
    texts = [*clean, *bad, "Der Bøk", "Lšhmung", "wait—what"]
    rows = {r["doc_id"]: r["text"] for r in E.damaged(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows == {23: "Keine Lösung", 24: "Im Café hier", 25: "Ein Café"}
