import base64
import collections
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from txnlens.llm import packing, scratch, warc, word_bpe
from txnlens.llm.queries import QUERIES

# --- WARC ---


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "z", "y") for i, u, h in rows],
                                 "page_id bigint, url string, html string, digest string, payload string")


PAGES = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c/\nx", None), (4, "http://d", ""),
         (5, "http://e", "only"), (None, "http://f", "<p>é</p>"), (6, "http://g", "\r\n\r\nWARC/1.1\r\n"), (7, "http://h", "big" * 300_000)]


def test_round_trip_rules(spark):
    folder = scratch.new_path(spark, "warc")
    out = warc.round_trip(pages(spark, PAGES), folder).collect()
    by = {r["record_id"]: r for r in out}
    assert len(out) == len(PAGES)
    for i, url, html in PAGES:
        r, payload = by[f"<urn:page:{i}>"], (html or "").encode()
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["url"] == (" ".join(url.split()) if url else None)
    assert {i: (by[f"<urn:page:{i}>"]["record_type"], by[f"<urn:page:{i}>"]["refers_to"]) for i in (1, 2, 3, 4, 5, None)} == {
        1: ("revisit", "<urn:page:2>"), 2: ("response", None), 3: ("revisit", "<urn:page:4>"), 4: ("response", None),
        5: ("response", None), None: ("revisit", "<urn:page:2>")}


def test_small_payloads_are_responses_where_a_least_size_is_set(spark):
    out = warc.with_revisits(pages(spark, PAGES), least_bytes=1).collect()
    assert {r["page_id"]: r["response_id"] for r in out if r["page_id"] in (1, 3, 4)} == {1: 2, 3: None, 4: None}


def test_files_roll_over_and_payloads_come_back(spark):
    folder = scratch.new_path(spark, "warc")
    rows = [(i, f"http://x/{i}", "".join(random.Random(i).choices("abcdef", k=5000))) for i in range(40)]
    files = scratch.write(warc.write_archives(warc.with_revisits(pages(spark, rows)).repartition(2), folder, file_bytes=20_000), "files")
    assert files.count() > 4
    got = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(files, folder, with_payload=True).collect()}
    assert got == {f"<urn:page:{i}>": h for i, _, h in rows}


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def _archive(payloads):
    return b"".join(warc.page_record(i, f"http://x/{i}", p, None) for i, p in enumerate(payloads))


def test_reader_frames_records_whatever_the_read_size():
    data = _archive([b"", b"one", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n", bytes(range(256)) * 999])
    for size in (1, 7, 1 << 16):
        source = io.BytesIO(data)
        records = list(warc.read_records(lambda n, s=size, f=source: f.read(min(n, s))))
        assert [r.http()[1] for r in records][1] == b"one" and len(records) == 4
        assert [r.offset for r in records] == [0, *np.cumsum([len(x) for x in map(lambda p: warc.page_record(*p), [
            (i, f"http://x/{i}", r.http()[1], None) for i, r in enumerate(records)])])[:-1].tolist()]


def test_each_record_is_a_gzip_member():
    data, n = _archive([b"a", b"b"]), 0
    while data:
        d = zlib.decompressobj(wbits=31)
        assert d.decompress(data).startswith(b"WARC/1.1\r\n")
        data, n = d.unused_data, n + 1
    assert n == 2


@pytest.mark.parametrize("damage", ["cut", "digest", "length_up", "length_down", "no_length", "not_warc", "not_gzip", "no_http_end"])
def test_damaged_archives_are_refused(damage):
    plain = gzip.decompress(warc.page_record(1, "http://x", b"payload", None))
    data = {
        "cut": lambda: gzip.compress(plain)[:-20],
        "digest": lambda: gzip.compress(plain.replace(b"payload\r\n", b"pAyload\r\n")),
        "length_up": lambda: gzip.compress(_longer(plain, 3)),
        "length_down": lambda: gzip.compress(_longer(plain, -3)),
        "no_length": lambda: gzip.compress(plain.replace(b"\r\nContent-Length: ", b"\r\nX-Length: ", 1)),
        "not_warc": lambda: gzip.compress(b"HTTP/1.1 200\r\n\r\n"),
        "not_gzip": lambda: plain,
        "no_http_end": lambda: warc.record_bytes([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.sha1(b"x"))], b"no head"),
    }[damage]()
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(data).read))


def _longer(plain, by):
    head, mark, rest = plain.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    at = max(i for i, x in enumerate(lines) if x.startswith(b"Content-Length: "))
    lines[at] = b"Content-Length: %d" % (int(lines[at].split()[1]) + by)
    return b"\r\n".join(lines) + mark + rest


def test_warc_query_covers_all_pages(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    out = QUERIES["op1_warc"](spark, SF_SMALL).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in out} == {
        i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, h in rows.items()}


# --- packing ---


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id bigint, text string, length int, part string")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet=" \n\t\x1c\x1f\x85\xa0 a'sΣİé́<|end>", max_size=40)), max_size=5))
def test_ids_equal_the_tokenizers(texts):
    encoder = _encoder()
    got = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [
        encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_chunk_is_encoded_once_in_one_case(monkeypatch):
    encoder = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    met, ids = [], encoder._chunk_ids
    monkeypatch.setattr(encoder, "_chunk_ids", lambda chunks: met.extend(chunks) or ids(chunks))
    texts = ["Word, word, WORD,\u00a0x", None, "", " word,\tJ\u030c j\u030c", "WORD, é É\x1cé"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
        encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert met.count("word,") == 1 and "WORD," not in met and len(met) == len(set(met))


def test_words_are_merged_without_the_tokenizer(monkeypatch):
    encoder = packing.Encoder(packing.tokenizer_path(packing.TOKENIZER))
    met, ids = [], encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda chunks: met.extend(chunks) or ids(chunks))
    texts = ["don't you'LLx ''s 's's it're, x've2'd 10½ Große _a_ 'rе", "“Ñandú”… привет-мир Σας", "漢字 <|ENDOFTEXT|>a<|endoftext|>B", "a" * 5000]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
        encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(met) == {"漢字", "<|ENDOFTEXT|>a<|endoftext|>B", "a" * 5000}


def test_characters_are_taken_as_the_tokenizer_does():
    encoder = _encoder()
    texts = [f"x{c}y {c}{c} 1{c}'s{c}.{c}" for c in map(chr, (*range(0x3100), *range(0xFB00, 0x10400)))]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
        x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("merges, agree", [
    ([("a", "b"), ("ab", "c</w>")], True),
    ([("a", "b"), ("a", "bc"), ("b", "c")], False),                  # a part comes later
    ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], False),     # a token of two merges
    ([("a", "b"), ("b", "c"), ("a", "bc")], False),                  # its symbols don't merge to it
])
def test_only_tables_that_merge_alike_are_taken(merges, agree):
    assert word_bpe.merges_agree(merges, "</w>") is agree


_kept = []


def _encoder():
    if not _kept:
        _kept.append(packing.Encoder(packing.tokenizer_path(packing.TOKENIZER), cache=50))
    return _kept[0]


def check_packing(rows, ids, most=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= most
    of = collections.defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    for i, whole_ids in ids.items():
        at = 0
        for r in sorted(of[i], key=lambda r: r["start"]):
            piece = np.array(whole_ids[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(piece), len(whole_ids))
            at += r["length"]
        assert at == len(whole_ids)
    return len(by)


def test_pieces_and_sequences(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "hello world"), (4, "word " * 5000), (5, "x" * 3000), (None, "no id")]
    out = packing.pack(packing.tokenize(docs(spark, rows))).collect()
    check_packing(out, {i: whole(tokenizer, t) for i, t in rows})


def test_repeated_rows_are_packed_once_each(spark, tokenizer):
    out = packing.pack(packing.tokenize(docs(spark, [(1, "same text")] * 5))).collect()
    assert len(out) == 5 and len({(r["sequence_id"], r["offset"]) for r in out}) == 5


def test_no_documents(spark):
    assert packing.pack(packing.tokenize(docs(spark, []))).count() == 0


def test_query_packs_all_documents_tightly(spark, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    out = QUERIES["op7_pack"](spark, SF_SMALL).collect()
    ids = {i: whole(tokenizer, t) for i, t in rows}
    assert check_packing(out, ids) <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(1, "one two three"), (2, "four"), (3, "five six " * 2000)]
    packed = packing.pack(packing.tokenize(docs(spark, rows), with_ids=True))
    pieces = packed.collect()
    for r in packing.sequences(packed).collect():
        want = [x for p in sorted((p for p in pieces if p["sequence_id"] == r["sequence_id"]), key=lambda p: p["offset"]) for x in p["ids"]]
        assert r["ids"] == want and r["length"] == len(want)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_places_every_piece_once(histogram):
    patterns = packing.plan(histogram, 64)
    got = collections.Counter()
    for pattern, count in patterns:
        assert sum(length * copies for length, copies in pattern) <= 64 and count > 0
        for length, copies in pattern:
            got[length] += copies * count
    assert got == histogram
    tokens = sum(k * v for k, v in histogram.items())
    assert sum(c for _, c in patterns) <= 2 * -(-tokens // 64) + 1
    places = packing.places(patterns)
    for length in histogram:
        own = places[places[:, 0] == length]
        assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all()


def brute_shortest_pack_first(histogram, limit):
    """Fill of every pack, piece by piece."""
    fill = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = min(range(len(fill)), key=fill.__getitem__, default=None)
            if at is not None and fill[at] + length <= limit:
                fill[at] += length
            else:
                fill.append(length)
    return collections.Counter(fill)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 25), max_size=25))
def test_plan_equals_shortest_pack_first(histogram):
    got = collections.Counter()
    for pattern, count in packing.plan(histogram, 64):
        got[sum(length * copies for length, copies in pattern)] += count
    assert got == brute_shortest_pack_first(histogram, 64)


def test_each_pack_takes_one_piece_before_the_next():
    assert packing.plan({1100: 3, 300: 3}) == [([(1100, 1), (300, 1)], 3)]


def test_rows_alike_are_dealt_over_the_parts(spark):
    rows = [(None, None)] * 3000 + [(1, "one two")]
    out = packing.pack(packing.tokenize(docs(spark, rows))).collect()
    assert len(out) == 3001 and len({(r["sequence_id"], r["offset"]) for r in out}) == 3001
    assert len({r["sequence_id"] for r in out}) == 2
