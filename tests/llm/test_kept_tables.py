import pyarrow as pa
import sentencepiece

from factloom.llm import tokens
from factloom.llm.common import released


def test_tables_of_encodings_go_with_the_next_task_of_another_operator():
    enc = tokens.encoder(tokens.default_model())
    texts = ["plain words and more words", "", None, "odd ⁇ \x00 é\U0001f600 \n\n x", "▁mark ▁ ▁▁", "  two  spaces "]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())

    def matches():
        for text, (ids, raw, n) in zip(texts, enc.encode_column(pa.array(texts, pa.string()))):
            want = sp.encode(text or "")
            assert ids.decode() == ",".join(map(str, want)) and n == len(want) and tokens.text_of(raw) == sp.decode(want)

    matches()
    released(tables=False)
    assert len(enc.kept) > 0 and len(enc.fits) > 0
    enc.kept.old = {"old": b"1"}
    released()
    assert not enc.kept and not enc.kept.old and not enc.fits and not enc.fits.old
    matches()


def test_an_entry_holds_the_ids_alone_where_they_stand_for_the_cut():
    enc = tokens.encoder(tokens.default_model())
    assert isinstance(enc.kept["▁word"], bytes)
    assert enc.of_cut("▁word") == (enc.kept["▁word"], b" word", enc.kept["▁word"].count(b",") + 1)
