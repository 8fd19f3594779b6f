"""Encoders of new words: what they keep, and which library calls they make."""

import random

import numpy as np

from taxolens.llm import sentencepiece_fst as S
from taxolens.llm import token_store as T

LETTERS = "ab  .,!?éñÀßİΣσςǅЖж'sſ%$#\n\t中文字🙂0129ⅣＡＢᲉꟋ́̈\x1c-_"


def odd_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_pairs_of_pieces_are_kept_when_words_have_no_room():
    fst = S.Transducer(S.default_model())
    fst.words.add({str(k): bytes(10**6) for k in range(200)})
    fst.words.add({f"_{k}": b"" for k in range(10_000)})
    fst.encode("unheard wordings")
    assert len(fst._follows) > 0


def test_automaton_gives_the_ids_of_the_public_library():
    import sentencepiece
    sp, fst = sentencepiece.SentencePieceProcessor(model_file=S.default_model()), S.Transducer(S.default_model())
    for text in ["internationalisation of wordings", "a", "☃☃", *odd_texts(500)]:
        assert fst.encode(text).tolist() == sp.encode(text)
    assert fst.n_arcs == sum(map(len, fst.arcs)) > 0


def test_automaton_without_room_for_arcs(monkeypatch):
    kept = S.Transducer(S.default_model())
    monkeypatch.setattr(S, "MAX_ARCS", 0)
    none = S.Transducer(S.default_model())
    for text in odd_texts(50):
        assert none.encode(text).tolist() == kept.encode(text).tolist()
    assert none.n_arcs == 0


def test_settled_words_are_not_normalised_again():
    enc = T.Encoder(T.default_vocabulary())
    tok, enc.tok = enc.tok, None
    text = "Wordings, unheard of. 'Tis çà et là 42%"
    want = np.array(tok.encode(text, add_special_tokens=False).ids, enc.dtype).tobytes()
    assert enc.encode(text) == want == enc.encode(text)


def test_ids_of_odd_texts_are_those_of_the_library():
    enc = T.Encoder(T.default_vocabulary())
    for text in odd_texts(800):
        assert enc.encode(text) == enc._ids(text)


def test_new_words_of_plain_letters_skip_the_byte_mapping():
    enc = T.Encoder(T.default_vocabulary())
    text = "Wordings, unheard of. 'Tis 42% and... so on!."
    want = enc._ids(text)
    enc.tok = enc.plain = None
    assert enc.encode(text) == want == enc.encode(text)


def test_ids_around_control_characters_and_wide_blanks_are_those_of_the_library():
    enc = T.Encoder(T.default_vocabulary())
    for text in ("one.\u00a0two,\u3000three. \u0085four", "\x00\x01 a\x7fb. \x08,", "\u00a0", "\u2028. é. ɐ.\u2003ß,\tz.",
                 "Ɂẞ’s it's.", "a. b,\nc.\r\nd.", "."):
        assert enc.encode(text) == enc._ids(text) == enc.encode(text)


def test_a_vocabulary_whose_words_have_no_last_mark_gives_the_same_ids():
    enc = T.Encoder(T.default_vocabulary())
    text = "Wordings, unheard of. 'Tis çà et là 42% \u00a0 漢字"
    want, enc.last = enc._ids(text), None
    assert enc.encode(text) == want
