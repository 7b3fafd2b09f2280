from itertools import product

import numpy as np
import pytest

from siftmill.llm import mojibake as M

CLEAN = [
    "Der Prüfbericht über die Maßnahme läuft nächstes Jahr aus – größer als der Kühlraum.", "Le relevé décrit un côté très âgé, près du dépôt où l’été coûte 30 €.",
    "¿Dónde está el número? Según la búsqueda, quedó en el catálogo. ¡Atención! Mañana caducará el análisis.", "Łącznie znaleziono kopii, które są częścią źródła błędu; więc proszę nie usuwać.",
    "Отчёт находится в каталоге, но снимок ещё не подписан. Файл не удаляйте, это единственная копия.", "A descrição do depósito já está incluída no catálogo. INFORMAÇÃO: OS ÍNDICES ESTÃO VAZIOS.",
    "The café near the façade isn’t open – see “résumé” of last year… Cost: €104.", "索引は未確認です。報告書を削除しないでください。写真が必要です。", "√2 ≤ x² ± 5 µm, 20 °C © ® ½ § 7", "ΑΒΓ αβγ ├── └── │ 👩‍🔬 ﬁle № ① ㎏ été ñ",
]


class Known:
    """What a model says of cores, asked one by one."""

    def __init__(self, model, margin):
        self.model, self.margin = model, margin

    def get(self, core):
        return self.model.best(core, self.margin)


@pytest.fixture(scope="module")
def known(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 200], "t string")
    counts, margin = M.train(M.corpus_cores(df, "t"))
    return Known(M.Model(counts), margin)


def test_clean_texts_are_sound(known):
    assert all(M.repair_text(t, known) is None for t in CLEAN)
    assert M.repair_text("plain ASCII", known) is None


@pytest.mark.parametrize("wrong,right,times,which", [("cp1252", "utf-8", 1, range(7)), ("cp1252", "utf-8", 2, (0, 1, 2)), ("latin-1", "utf-8", 1, range(8)), ("cp1251", "utf-8", 1, (0, 1, 4)), ("mac_roman", "utf-8", 1, (0, 1, 2)), ("cp437", "utf-8", 1, (0, 2)), ("cp850", "utf-8", 1, (1,)), ("cp1252", "cp1251", 1, (4,)), ("koi8-r", "cp1251", 1, (4,)), ("cp1252", "cp1250", 1, (3,))])
def test_round_trips(known, wrong, right, times, which):
    for i in which:
        garbled = M.damage(CLEAN[i], wrong, right, times)
        if garbled is None:
            continue
        found = M.repair_text(garbled, known)
        assert found is not None
        if right == "utf-8":
            assert found[0] == CLEAN[i]


def test_one_word_and_broken_text(known):
    found = M.repair_text("The cafÃ© is open", known)
    assert found[0] == "The café is open" and found[1] == ["cp1252>utf-8"] and found[3]
    found = M.repair_text("The caf� is open", known)
    assert found is not None and not found[3]


def test_cores():
    text = "ab cafÃ©s x–y–z\tabcdé\x7fü a\xa0b éabéabcdeé ü" + "é" * 3
    assert list(M.cores(text)) == M.CORE.findall(text) == ["afÃ©s", "x–y–z", "cdé", "ü", "a\xa0b", "éabéab", "deé", "üééé"]


def test_any_bytes_are_read_or_left():
    lead, follow = range(0xC0, 0x100), (*range(0x80, 0x100, 7), 0x9F, 0xA0, 0xBF)
    for n in (1, 2, 3):
        for first in lead:
            for rest in product(follow, repeat=n):
                raw = "".join(map(chr, (first, *rest)))
                data = raw.encode("latin-1")
                try:
                    want = data.decode("utf-8")
                except UnicodeDecodeError:
                    want = None
                if (got := M.by_utf8(raw, raw)) is None or want is not None:
                    assert got == want
    for surrogate in ("\xed\xa0\x80", "\xed\xbf\xbf", "a\xed\xb2\x80z"):
        assert M.by_utf8(surrogate, surrogate) is None and list(M.chains(surrogate))


def test_repair(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 30)] + [(9001, M.damage(CLEAN[1], "cp1252", "utf-8")), (9002, None), (9003, ""), (9001, M.damage(CLEAN[1], "cp1252", "utf-8")), (9004, "é " * 100_000), (9005, "caf\xed\xa0\x80 no"), (9006, "a � b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as restored", "2 as gain", "3 as t")
    for most in (M.BROADCAST_CHARACTERS, 0):  # the changed cores are broadcast, and joined
        out = {(r["doc_id"], r["restored"], r["whole"]): r for r in M.repair(df, "doc_id", "text", most).collect()}
        assert sorted(out) == [(9001, CLEAN[1], True), (9005, "caf\xed\xa0\x80 no", False), (9006, "a � b", False)]
        assert M.repair(df, "doc_id", "text", most).count() == 4
    assert M.repair(df.limit(0), "doc_id", "text").count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 20], "t string")
    a, b = (M.train(M.corpus_cores(df.repartition(n), "t")) for n in (1, 9))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_held_out_damage_is_found(spark):
    """Cores that the model never saw, damaged: nearly all are found and restored at the margin that was chosen."""
    words = [a + b + c for a in ("größ", "prüf", "läng", "fäll", "müll", "höh", "täg", "schön", "küh", "grün") for b in ("er", "ung", "lich", "bar", "haft") for c in ("", "en", "es", "e")]
    df = spark.createDataFrame([(f"{CLEAN[i % 7]} {w}",) for i, w in enumerate(words) if i % 5], "t string")
    counts, margin = M.train(M.corpus_cores(df, "t"))
    model, unseen = M.Model(counts), [w for i, w in enumerate(words) if i % 5 == 0]
    for wrong, right, times in M.DAMAGES[:5]:
        cores = [(c, M.damage(c, wrong, right, times)) for w in unseen for c in M.cores(w)]
        found = [(top := model.best(g, margin)) is not None and top[1] == c for c, g in cores if M.CORE.fullmatch(g) and not M.BROKEN.search(g)]
        assert sum(found) >= 0.95 * len(found)
    assert not any(model.best(c, margin) for w in unseen for c in M.cores(w))


def test_frequent_damage_is_not_learned(spark):
    hot = M.damage(CLEAN[1], "cp1252", "utf-8")
    rows = [(i, f"{t} {i}") for i, t in enumerate(CLEAN * 30)] + [(1000 + i, hot) for i in range(100)]  # copies of one text
    rows += [(2000 + i, f"{M.damage(CLEAN[i % 2], 'cp1252', 'utf-8')} {i}") for i in range(100)]  # a source of different texts
    out = {r["doc_id"]: r["restored"] for r in M.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert set(out) == {*range(1000, 1100), *range(2000, 2100)}
    assert {out[i] for i in range(1000, 1100)} == {CLEAN[1]} and all(out[2000 + i] == f"{CLEAN[i % 2]} {i}" for i in range(100))


def test_all_cores_validate_the_margin(spark):
    """Established cores that a small margin would change come after more than 2,000 others."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    ends = [(letters[i % 26], letters[(i * 7 + i // 26) % 26]) for i in range(100)]
    rows = [(f"{a}é{b}", 2500) for a, b in ends] + [(chr(0x4E00 + i), 110) for i in range(2000)] + [(f"{a}Ã©{b}", 100) for a, b in ends]
    table = spark.createDataFrame(rows, "core string, n long")
    counts, margin = M.learned(table)
    assert int(counts[M.offset(1) + M.slot("\x03") % M.SLOTS[2]]) == sum(n for _, n in rows)
    changed = [top[0] for c, n in rows if n == 100 and (top := M.Model(counts).best(c, M.MARGINS[0])) is not None]
    assert len(changed) == 100 and margin > max(changed)
    assert M.learned(table.repartition(7))[1] == margin


def test_every_core_is_tried():
    items = [(a + b + c, 3) for a in ("größ", "prüf", "läng") for b in ("er", "ung", "lich") for c in ("", "en")]
    items = [(core, n) for text, n in items for core in M.cores(text)]
    model = M.Model(M.tally(np.zeros(sum(M.SLOTS), np.int64), items))
    found = M.trials(model, model, items, 4)
    garbled = [g for c, _ in items for d in M.DAMAGES if (g := M.damage(c, *d)) not in (None, c) and M.CORE.fullmatch(g) and not M.BROKEN.search(g)]
    assert sum(found.values()) == len(garbled) >= len(items)
    assert sum(n for (established, _), n in M.trials(model, model, items, 3).items() if established) == len(items)
