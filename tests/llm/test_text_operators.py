"""License scans, secrets, audio, tokens, packing: small tables against plain re-computation."""

import hashlib
import random
import re
import zlib

import pytest

from tidecast.llm import bpe, license_scan, mpeg_audio, packing, secret_scan, token_files

SCHEMA = "doc_id long, text string, score string, n_words string"
ODD = [
    (1, None, "x", "y"),
    (2, "", "x", "y"),
    (3, "Licensed under the Apache License, Version 2.0.", "x", "y"),
    (3, "Licensed under the Apache License, Version 2.0.", "x", "y"),
    (None, "under the MIT license, under the mit licensé", None, None),
    (4, "a " * 20_000 + "CC-BY-NC", "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def by_text(rows):
    return sorted((r.asDict() for r in rows), key=str)


def test_licenses(odd):
    rows = {(r.doc_id, r.n_words): r for r in license_scan.scan_licenses(odd).collect()}
    assert len(rows) == 5  # the repeated row is there twice
    assert rows[(1, 0)].labels == rows[(2, 0)].labels == "" and rows[(1, 0)].first_word is None and rows[(1, 0)].score == 0
    apache = rows[(3, 8)]
    assert (apache.n_base, apache.first_word, apache.last_word, apache.base_labels, apache.score) == (1, 3, 3, "apache-2", 1.0)
    none = rows[(None, 8)]
    assert none.n_base == 1 and none.base_labels == "mit"
    assert rows[(4, 20_003)].first_word == 20_000


def test_license_places_against_search():
    """The automaton of a phrase finds what a plain search over words finds."""
    rng = random.Random(1)
    phrase = license_scan.Automaton("cc by nc")
    for _ in range(200):
        words = [rng.choice(["cc", "by", "nc", "x"]) for _ in range(rng.randint(0, 30))]
        want = [i for i in range(len(words)) if words[i : i + 3] == ["cc", "by", "nc"]]
        assert [a for a, _ in phrase.places(words)] == want


def test_template_markup_against_regex():
    """Optional and replaceable regions accept what the regular expression of the template accepts."""
    rng = random.Random(2)
    template = license_scan.Automaton("a <<optional>>b <<optional>>c<</optional>><</optional>> <<var:1-2>> d")
    pattern = re.compile(r"(?= a( b( c)?)?( \w){1,2} d(?= |$))")
    for _ in range(500):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        joined = "".join(f" {w}" for w in words)
        want = [m.start() // 2 for m in pattern.finditer(joined)]
        assert [a for a, _ in template.places(words)] == want
    with pytest.raises(ValueError):
        license_scan.Automaton("a <<optional>> b")


def test_mandatory_wording_of_each_template():
    """Any choice of the optional and replaceable words is accepted; a changed or missing mandatory word never is."""
    rng = random.Random(4)
    for label, template in license_scan.TEMPLATES.items():
        automaton = license_scan.Automaton(template)
        for _ in range(20):
            words, mandatory, opened = [], [], []
            for piece in re.split(r"(<<[^>]*>>)", template):
                mark = license_scan.MARKUP.fullmatch(piece)
                if mark and mark[1] == "optional":
                    opened.append(rng.random() < 0.5)
                elif mark and mark[1] == "/optional":
                    opened.pop()
                elif all(opened):
                    new = [rng.choice(["zz", "Öz"]) for _ in range(rng.randint(int(mark[2]), int(mark[3])))] if mark else piece.split()
                    mandatory += [len(words) + i for i in range(len(new)) if not mark and not opened]
                    words += new

            def labels(words):
                text = "Before, " + " ".join(rng.choice(["{}", "{}.", "({})\n"]).format(w.upper() if rng.random() < 0.2 and w.isascii() else w) for w in words) + " after"
                return license_scan.scan_text(text, [], [(automaton, label)])["labels"].split(",")

            assert label in labels(words)
            for i in rng.sample(mandatory, min(8, len(mandatory))):
                assert label not in labels(words[:i] + ["zz"] + words[i + 1 :]) and label not in labels(words[:i] + words[i + 1 :])


def test_secrets(spark, odd):
    good = "ghp_" + "a" * 30
    good += secret_scan.base62(zlib.crc32(b"a" * 30), 6)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f'é Password = "hunter22222" token:short AKIA{"A" * 16} {"0a" * 16} {good} {bad} ſecret=12345678'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in secret_scan.scan_secrets(rows).collect()}
    assert (found[1].n_assign, found[1].n_access, found[1].n_hex) == (1, 1, 1)
    kinds = [s.split(":") for s in found[1].spans.split(",")]
    assert [k for k, *_ in kinds] == ["assign", "access", "hex", "forge-token"]
    assert text[int(kinds[3][1]) : int(kinds[3][2])] == good
    assert found[2].spans == "" and found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.scan_secrets(odd).count() == len(ODD)


def test_secrets_against_plain_search():
    rng = random.Random(3)
    automaton = secret_scan.keyword_automaton()
    parts = ["password", "PASSWD", "token", "api_key", "apikey", "=", ":", " ", '"', "abcdefgh", "12345678901234567890", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef" * 2, "é", "Secret"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [(m.start(), m.end(), "assign") for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), m.end(), "access") for m in secret_scan.ACCESS.finditer(text) if len(m[0]) >= 16]
        want += [(m.start(), m.end(), "hex") for m in secret_scan.HEX.finditer(text) if len(m[0]) >= 32]
        got = [s for s in secret_scan.find_secrets(text, automaton) if s[2] in secret_scan.KINDS[:3]]
        assert got == sorted(want, key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))


@pytest.mark.parametrize("n", [0, 1, 64, 1408, 1409, 50_000])
def test_audio_round_trip(n):
    data = random.Random(n).randbytes(n).replace(b"\xff", b"a")
    payload = data.ljust(max(64, -(-n // 64) * 64), b"\0")
    stream = mpeg_audio.write_mpeg(payload, n)
    parsed = mpeg_audio.parse_mpeg(stream)
    assert mpeg_audio.stored_payload(parsed) == (payload, n)
    assert parsed["bad_crc"] == parsed["lost_bytes"] == 0 and parsed["table_frames"] == len(parsed["offsets"])
    assert parsed["samples"] == 1152 * len(parsed["offsets"]) and all(mpeg_audio.header(stream[o : o + 4]) for o in parsed["offsets"])


def test_audio_damage():
    payload = bytes(range(1, 129)) * 100
    stream = mpeg_audio.write_mpeg(payload, len(payload))
    clean = mpeg_audio.parse_mpeg(stream)
    at = clean["offsets"][3]
    junk = stream[:at] + b"junk \xff\xfb\x00" + stream[at:]
    parsed = mpeg_audio.parse_mpeg(junk)
    assert parsed["lost_bytes"] >= 8 and len(parsed["offsets"]) >= len(clean["offsets"]) - 1
    broken = bytearray(stream)
    broken[at + 8] ^= 1
    assert mpeg_audio.parse_mpeg(bytes(broken))["bad_crc"] == 1
    assert mpeg_audio.parse_mpeg(b"") == mpeg_audio.parse_mpeg(b"") and mpeg_audio.parse_mpeg(b"no audio")["offsets"] == []


def test_media_columns(odd):
    rows = by_text(mpeg_audio.media_columns(mpeg_audio.store_media(odd)).drop("seek_offsets").collect())
    assert len(rows) == len(ODD)
    for r in rows:
        texts = {t for d, t, *_ in ODD if d == r["doc_id"]}
        assert any(r["n_bytes"] == len((t or "").encode()) for t in texts)
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"])
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and one["tail_crc32"] == zlib.crc32(bytes(64))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_cached_ids_equal_the_library(library):
    rng = random.Random(5)
    enc = bpe.encoder(bpe.default_vocabulary())
    alphabet = "abcXYZ01 .,'!?\n\tsßéÀ²¼×÷­ 　中🙂\r\x1c\x85<|>_-ſİ"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(enc.encode(text)[i : i + 4], "little") for i in range(0, 4 * len(want), 4)] == want, repr(text)
        assert len(enc.encode(text)) == 4 * len(want)
    assert enc.encode("don't we'll 12.5  x<|endoftext|>") == b"".join(i.to_bytes(4, "little") for i in library.encode("don't we'll 12.5  x<|endoftext|>", add_special_tokens=False).ids)


def test_cutting_and_a_cache_that_turns_over(library):
    """Texts of few classes of characters, many at a time, cut into short segments, with caches of a few pieces."""
    rng, enc = random.Random(6), bpe.Encoder(bpe.default_vocabulary(), cache_chars=300, chars_at_once=40)
    for _ in range(3000):
        alphabet = rng.choice(["ab 's1é\n\t.-  ĀZ’漢<|", "'stmdrevl a.\n", "' sr\te5", "abcdefghijklm ", " \n\t", "\0a", "éÿĀāa "])
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        want = [b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert enc.encode_all(texts) == want, texts


def test_token_files(spark, odd, library, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd.repartition(3), path, end_id=0)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((d for d, *_ in ODD), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        assert any(r.ids[:-1] == library.encode(t or "", add_special_tokens=False).ids for d, t, *_ in ODD if d == r.doc_id)
        at += r.n_tokens
    digest = {(r.doc_id, r.start): r for r in token_files.ids_digest(token_files.read_tokens(spark, path)).collect()}
    for r in rows:
        assert digest[(r.doc_id, r.start)].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
    part = token_files.read_tokens(spark, path, 2, 3)
    assert {r.doc_id for r in part.select("doc_id").collect()} == {2, 3}
    plan = part.select("doc_id", "start", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ids" not in plan.split("ReadSchema")[-1].split("\n")[0]
    empty = str(tmp_path / "empty")
    token_files.write_tokens(odd.limit(0), empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def check_pieces(rows, cap, segments, loss):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
    for (_, total), parts in docs.items():
        parts.sort()
        copies = sum(start == 0 for start, _ in parts)
        assert sum(n for _, n in parts) == copies * total
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, n, _ in parts:
            assert offset == at and n > 0
            at += n
        assert at <= cap and len(parts) <= segments and sum(p[2] for p in parts) <= loss
    return sequences


def test_packing(spark, odd, library):
    rows = packing.pack(odd).collect()
    sequences = check_pieces(rows, 2048, 512, 2048)
    lengths = [sum(n for _, n, _ in p) for p in sequences.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    text = {d: t or "" for d, t, *_ in ODD}
    for r in rows:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        piece = ids[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_limits(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 120))), rng.randint(0, 40)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, prompt int")
    rows = packing.pack(df, prompt_col="prompt", max_tokens=256, max_segments=6, max_loss_tokens=180).collect()
    check_pieces(rows, 256, 6, 180)


def test_web_tokens_in_long_runs_take_linear_time():
    """Ten million characters of token starts without a token, and the spans of plain matching on smaller ones."""
    import time

    automaton, rng = secret_scan.keyword_automaton(), random.Random(6)
    began = time.time()
    assert secret_scan.find_secrets("eyJ" * 3_300_000 + ".", automaton) == []
    assert time.time() - began < 60
    head = "eyJhbGciOiJub25lIn0"
    for _ in range(300):
        text = "".join(rng.choice([head, "eyJ", "eyJx", ".", ".", " ", "a-_", head + ".a."]) for _ in range(rng.randint(0, 14)))
        want, end = [], 0
        for m in re.finditer("(?=eyJ)", text):
            if m.start() >= end and (t := secret_scan.JWT.match(text, m.start())):
                end = t.end()
                if secret_scan.header_holds(t):
                    want.append((t.start(), t.end(), "jwt"))
        assert [s for s in secret_scan.find_secrets(text, automaton) if s[2] == "jwt"] == want


def test_instructions_meet_all_limits(spark, library):
    """Conversations: every answer's ids lie in one piece each, loss is that of the answers, and no limit is passed."""
    from tidecast.llm import registry

    rows = registry.packing_instructions(spark, "/root/testdata/sf0.01").collect()
    sequences = check_pieces(rows, 2048, 6, 1800)
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()}
    answers = {c << 20 | t: r.text for (c, t), r in turns.items() if r.role == "assistant"}
    assert {r.doc_id for r in rows} == set(answers)
    loss = {}
    for r in rows:
        loss[r.doc_id] = loss.get(r.doc_id, 0) + r.loss_tokens
    for d, text in answers.items():
        assert loss[d] == len(library.encode(text, add_special_tokens=False).ids) + 1
    of_sequence = {}
    for r in rows:
        n = of_sequence.setdefault(r.sequence_id, [0, 0, 0])
        n[:] = [n[0] + r.length, n[1] + 1, n[2] + r.loss_tokens]
    assert max(n[1] for n in of_sequence.values()) == 6 and max(n[0] for n in of_sequence.values()) == 2048
    assert len(sequences) == len(of_sequence)


def test_examples_of_odd_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "alone"), (None, 1, "assistant", "x"), (3, None, "assistant", "x"), (4, 5, "user", None), (4, 6, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in packing.instruction_examples(df).collect())
    assert got == [(1 << 20 | 1, "q\na", 2), (2 << 20, "alone", 0), (4 << 20 | 6, "\n", 1)]
