import random

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import mojibake as M

SENTENCES = {
    "de": "Für unser Büro in München suchen wir gründliche Unterstützung. Größere Umbauten führen Sie gemeinsam durch. Außerdem zählt für uns tägliche Übung.",
    "fr": "À Nîmes, nous cherchons une personne à l’écoute pour suivre la qualité des pièces. Après 3 mois, vous réglez vous-même l’atelier.",
    "es": "¿Te gusta Cáceres? Allí está nuestra dirección técnica. Además, revisarás el catálogo de baños cada mañana con 23 compañeros.",
    "pl": "Zgłoszenia czytamy w ciągu 15 dni, również po południu. Ważne są dla nas węzły sieci oraz większą podejście. Będziesz też łączyć księgi.",
    "ru": "Отклик прочитаем за 24 дней. Вам предстоит улучшить складской учёт вместе с командой. Мы ищем в городе человека.",
    "ja": "最初の22か月は在庫管理を学びます。小さなチームと一緒に給与計算を改善します。応募書類は13日以内に確認します。",
    "en": "The café opens at 9 o’clock – “Start small” is what our crew says. Pay is up to €44 a month, travel is paid.",
}
SCHEMA = "doc_id long, text string, id string, restored string"


def garble(text, written, read):
    return "".join(c for c in (M.byte_chars(read)[b] for b in text.encode(written)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    docs = []
    for i in range(900):
        lang = rng.choice(list(SENTENCES))
        parts = SENTENCES[lang].replace("。", "。|").replace(". ", ". |").replace("? ", "? |").split("|")
        docs.append("".join(rng.choice(parts) + (" " if lang != "ja" else "") for _ in range(6)).strip())
    return docs


@pytest.fixture(scope="module")
def restorer(corpus):
    return M.Restorer(M.Model(M.statistics(counted(corpus))))


def counted(corpus, times=1):
    """Counts of the texts and some garbled ones, as if each occurred so many times."""
    mixed = corpus + [garble(t, "utf-8", "cp1252") for t in corpus[:40]]
    rows = pa.Table.from_batches(M._counts(iter([pa.RecordBatch.from_arrays([pa.array(mixed)], names=["text"])])))
    return rows.set_column(2, "n", pa.array(rows.column("n").to_numpy() * times))


def test_a_corpus_of_any_size_is_judged_alike(corpus, restorer):
    """The same shares, a thousand times the counts."""
    large = M.Restorer(M.Model(M.statistics(counted(corpus, 1000))))
    texts = corpus[::30] + [garble(SENTENCES[lang], *how) for lang in SENTENCES for how in (("utf-8", "cp1252"), ("utf-8", "cp437"))] + [garble(SENTENCES["ru"], "cp1251", "cp1252"), garble(SENTENCES["pl"], "cp1250", "cp1252")]
    assert [large.restore(t) for t in texts] == [restorer.restore(t) for t in texts]


def test_slots_of_arrays_and_numbers_agree(restorer):
    x, y = np.array([32, 0xE9, 0x10FFFF]), np.array([0xE9, 0x3042, 0x10FFFF])
    a, b = M.slots(x, y)
    assert [M.slots(int(i), int(j)) for i, j in zip(x, y)] == list(zip(a.tolist(), b.tolist()))
    assert a.max() < M.PAIR_SLOTS <= b.min() and b.max() < M.TABLES * M.PAIR_SLOTS
    pairs = restorer.model.pairs
    assert pairs.get(0x10FFFF, 0xE000, None) is None and pairs.get(ord("ü"), ord("r"), None) < 0


def test_mappings_stay_inside_the_runs(restorer):
    text = "Ünïcode здесь и там."
    mapping = M.OneByte("cp1251", "cp1252")
    wrong = garble("здесь и там.", "cp1251", "cp1252")
    assert restorer._inside("Ün " + wrong, 0, 3 + len(wrong), [(3, 3 + len(wrong))], mapping) == "Ün здесь и там."
    assert restorer._inside("Ün " + wrong, 0, 3 + len(wrong), [], mapping) is None
    assert restorer.restore(text) is None


def test_clean_texts_stay(corpus, restorer):
    assert [t for t in corpus if restorer.restore(t) is not None] == []


@pytest.mark.parametrize("written, read, langs", [("utf-8", e, "de fr es pl ru en ja") for e in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman")] + [("cp1251", "cp1252", "ru"), ("cp1251", "latin-1", "ru"), ("cp1251", "koi8_r", "ru"), ("cp1250", "cp1252", "pl"), ("cp1252", "cp437", "de")])
def test_round_trip(restorer, written, read, langs):
    for lang in langs.split():
        text = SENTENCES[lang]
        assert restorer.restore(garble(text, written, read)) == text, (lang, written, read)


def test_layers_parts_and_quotations(restorer):
    de, en = SENTENCES["de"], SENTENCES["en"]
    twice = garble(garble(de, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restorer.restore(twice) == de
    assert restorer.restore(de + " " + garble(en, "utf-8", "cp1252")) == de + " " + en
    assert restorer.restore(de + " " + garble("Großer Übermut.", "cp1252", "cp437")) == de + " Großer Übermut."
    for quoted in ("Old exports print Â£ where £ was meant; you will fix it.", "You explain why é may show up as Ã© in a report.", "A column named Ð or Ñ is fine.", "The sign reads “ÂGE MÛR” and “PÃO”."):
        assert restorer.restore(en + " " + quoted) is None
    assert restorer.restore(None) is restorer.restore("") is restorer.restore("plain ASCII") is None


def test_segments_equal_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 12))]

        def define(lo, hi):
            best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return define(lo, best[2]) + [(best[2], best[3])] + define(best[3], hi)

        got, want = M.maximal_segments(s), define(0, len(s))
        assert [sum(s[a:b]) for a, b in got if sum(s[a:b]) > 0] == [sum(s[a:b]) for a, b in want]


def test_spark_rows(spark, corpus):
    bad = garble(SENTENCES["fr"], "utf-8", "cp1252")
    rows = [(i, t, "x", "y") for i, t in enumerate(corpus)] + [(2000, bad, "", ""), (2001, "K��ln", "", ""), (2002, None, "", ""), (2003, "", "", ""), (2004, "ascii " * 50000, "", ""), (2005, bad + " x" * 100000, "", "")]
    got = {r.id: r.restored for r in M.restored(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert got == {2000: SENTENCES["fr"], 2001: None, 2005: SENTENCES["fr"] + " x" * 100000}
    assert M.restored(spark.createDataFrame([], SCHEMA), "doc_id", "text").count() == 0


@pytest.mark.parametrize("lang, written, read", [("fr", "utf-8", "cp1252"), ("ru", "cp1251", "cp1252")])
def test_a_third_of_all_rows_is_one_garbled_text(spark, corpus, lang, written, read):
    bad, near = garble(SENTENCES[lang], written, read), 450
    rows = [(i, t, "", "") for i, t in enumerate(corpus)] + [(2000 + i, bad + (f" No {i}." if i % 2 else ""), "", "") for i in range(near)]
    got = {r.id: r.restored for r in M.restored(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert got == {2000 + i: SENTENCES[lang] + (f" No {i}." if i % 2 else "") for i in range(near)}
