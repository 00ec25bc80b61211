"""Operators that SQL can't express: round trips, and accuracy on rows that were held out."""

import bisect
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import language_id, matroska, quality_gam, warc
from lodeline.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    big = "é<p>" + "x" * 1500
    rows = [(i, f"http://h/{i} \n{i}", big if i % 3 else "".join(rng.choice("abc\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(60, None, None), (61, "u", ""), (62, "u", "small"), (63, "u", "small"), (5, "again", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "y", 3) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(4)
    uri = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, uri, shard_bytes=20_000, roll_bytes=1500)
    files = manifest.collect()
    assert len({f.shard for f in files}) > 2 and len(files) > len({f.shard for f in files}) and sum(f.records for f in files) == len(rows)
    assert all(hashlib.sha1((tmp_path / "w" / f.name).read_bytes()).hexdigest() == f.sha1 for f in files)
    got = warc.read_archives(manifest, uri).collect()
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        shared = h == big and i != 59
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if shared else "response", 59 if shared else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected, key=str)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.payload is not None)
    second = warc.write_archives(pages.repartition(7), f"file://{tmp_path}/v", shard_bytes=20_000, roll_bytes=1500).collect()
    assert sorted(second) == sorted(files)


def test_warc_damage_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a")
    path = tmp_path / "a" / manifest.first().name
    import gzip

    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"\r\n\r\ntext", b"\r\n\r\ntexT")))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(manifest, f"file://{tmp_path}/a").collect()
    assert warc.round_trip(pages.where("page_id = 2")).count() == 0


def test_codewords():
    assert language_id.codewords(1).shape == (1, 1)
    for n in (2, 3, 4, 5, 9, 40):
        code = language_id.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2) and len({tuple(c) for c in code.T}) == code.shape[1] or n > 5
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.full(7, 1 / 7), np.zeros((language_id.BUCKETS, 7), np.float32), code[2].astype(np.float32) * [1, 1, 1, -1, 1, 1, 1])
    best, score, _ = model.decode(np.zeros((1, language_id.BUCKETS)), np.zeros(1))
    assert best[0] == 2 and 0 < score[0] <= 1  # one wrong bit is corrected


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.predict(docs, language_id.learn(docs)).withColumn("held", held_out("doc_id"))
    hits = out.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert hits[0] > 0.97 and hits[1] >= 0 and hits[2] <= 1
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "123 -- !", 3), (2, "123 -- !", 3), (3, "x", 4), (4, "ab " * 300_000, 5)], "doc_id long, text string, score int")
    got = language_id.predict(odd, language_id.learn(docs)).collect()
    assert len(got) == 6 and all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got)
    assert all(r.score == 0 and r.ambiguous for r in got if r.lang_pred == "und")
    assert language_id.learn(docs.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    one = language_id.predict(odd, language_id.learn(docs.where("lang = 'de'"))).where("doc_id = 3").first()
    assert (one.lang_pred, one.ambiguous) == ("de", False)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_gam.learn(docs, labels)
    out = quality_gam.score(docs, model).join(labels, "doc_id").where(held_out("doc_id")).toPandas()
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.97
    assert ((out.predicted == 1) == (out.score >= 0.3)).all()
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "\n" * 10, 3), (3, "w " * 200_000, 4)], "doc_id long, text string, predicted int")
    got = quality_gam.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (None, 1)}) == 1
    assert quality_gam.learn(docs, labels.where("quality is null")) is None
    assert {r.score for r in quality_gam.score(odd, None).collect()} == {0.5}
    assert quality_gam.score(odd.where("doc_id = 9"), model).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert (model.score(x) != quality_gam.fit(x, np.ones(3000)).score(x)).any()


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing(kind):
    rng = np.random.default_rng(kind)
    for sizes in ([5, 5, 5], [700], [255, 510, 3, 0, 256, 9000], [1] * 40):
        if kind == matroska.FIXED and len(set(sizes)) > 1:
            continue
        parts = [rng.bytes(n) for n in sizes]
        data = b"??" + matroska.lace(parts, kind)
        assert [data[a : a + n] for a, n in matroska.frames(data, 2, len(data), kind)] == parts


def test_matroska_structure():
    e, v = matroska.element, matroska.number
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x82" + (5).to_bytes(2, "big") + b"\x00" + b"BB"))
    inner = e(matroska.TIMESTAMP, v(1000)) + e(matroska.SIMPLE_BLOCK, b"\x40\x83" + (-7).to_bytes(2, "big", signed=True) + b"\x80" + b"AAA") + group
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + inner
    segment = matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + e(matroska.CLUSTER, e(matroska.TIMESTAMP, v(3)))
    m = matroska.parse(e(matroska.EBML, e(matroska.DOC_TYPE, b"matroska")) + segment)
    assert [(t, s, i, n, key) for t, s, i, _, n, key in m.packets] == [(0x83, 993, 0, 3, True), (2, 1005, 0, 2, True)] and len(m.clusters) == 2
    with pytest.raises(ValueError):
        matroska.parse(matroska.write(b"x" * 100)[:-10])


def test_media_columns(spark):
    texts = [None, "", "é", "a" * 64, "b" * 65, "long " * 30_000, "long " * 30_000]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    media = matroska.media_column(docs)
    got = {r.doc_id: r for r in matroska.media_features(media).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5].feature == got[6].feature and got[5].media_sha256 == got[6].media_sha256 != got[4].media_sha256
    packets = matroska.packet_table(media.where("doc_id = 5")).orderBy("byte_start").collect()
    assert sum(p.byte_length for p in packets) == 150_016 and packets[-1].timestamp_ns > packets[0].timestamp_ns == 0
    m = matroska.parse(media.where("doc_id = 5").first().media)
    assert len(m.clusters) == 5 and {p for _, _, p in m.cues} == set(m.clusters) and m.tracks == {1: "A_PCM/INT/LIT"}
    assert matroska.media_features(matroska.media_column(docs.where("doc_id = 99"))).count() == 0


def plain_languages(model, text):
    """Loss-weighted decoding in loops: counts in a dict, a sum for each bit, a loss for each language."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, counts = text.lower().encode(), {}
    for k in (2, 3):
        for at in range(len(data) - k + 1):
            h = k
            for b in data[at : at + k]:
                h = (h ^ b) * 0x01000193 % 2**32
            slot = (h * 0x9E3779B1 % 2**32) >> (32 - 13)
            counts[slot] = counts.get(slot, 0) + 1
    n, bits = sum(counts.values()), []
    for bit in range(model.code.shape[1]):
        bits.append(sum(c * float(model.table[slot, bit]) for slot, c in counts.items()) / (n + 5.0) + float(model.bias[bit]))
    losses = [sum(float(w) * max(0.0, 1 - x * int(c)) for w, x, c in zip(model.weight, bits, row, strict=True)) for row in model.code]
    best = min(range(len(losses)), key=lambda i: losses[i])
    return model.languages[best], 1 / sum(np.exp(-8 * (x - losses[best])) for x in losses)


def test_language_id_is_the_plain_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs)
    rows = language_id.predict(docs, model).collect()
    assert len(rows) >= 200
    for r in rows:
        lang, score = plain_languages(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=2e-3)


def test_language_id_empty_and_clashing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs)
    empty = docs.where("doc_id < 0")
    assert language_id.predict(empty, model).count() == 0 and language_id.learn(empty) is None
    odd = docs.select("doc_id", "text", F.lit(1).alias("lower"), F.lit(2).alias("lettered"), F.lit("q").alias("lang_pred"))
    got = language_id.predict(odd, model)
    assert got.columns == ["doc_id", "text", "lower", "lettered", "lang_pred", "score", "ambiguous"] and {(r.lower, r.lettered) for r in got.collect()} == {(1, 2)}


def test_tiny_texts_take_little_memory():
    from tracemalloc import get_traced_memory, start, stop

    import pyarrow as pa
    from lodeline.llm.common import text_runs

    start()
    for _, n, data, offsets in text_runs(pa.array(["abcd"] * 10_000), *language_id._RUN):
        assert n <= language_id._RUN[1] and language_id.histograms(data, offsets)[0].shape[0] == n
    peak = get_traced_memory()[1]
    stop()
    assert peak < 100 << 20


def plain_features(text):
    """The features of one text, counted one by one."""
    data, words = text.encode(), re.findall(r"[^\x20\x09-\x0D]+", text)
    words = [w.encode() for w in words]
    n, count = len(data), len(words)
    share = lambda x: x / max(count, 1)
    out = [sum(b in bytes(members) for b in data) / max(n, 1) for members in quality_gam._CLASSES.values()]
    lines = sum(b in b"\n\r" for b in data)
    out += [np.log1p(count), np.log1p(n), share(sum(map(len, words))), share(sum(len(w) >= 16 for w in words)), share(sum(len(w) == 1 for w in words)), share(len(set(words)))]
    out += [len(set(zip(words, words[1:], strict=False))) / max(count - 1, 1), share(sum(a == b for a, b in zip(words, words[1:], strict=False))), count / (1 + lines)]
    return [*out, share(sum(0x41 <= w[0] <= 0x5A for w in words)), share(sum(w[-1:] in b".,;:!?" for w in words))]


def test_quality_is_the_plain_sum_of_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.learn(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = quality_gam.score(docs, model).collect()
    assert len(rows) >= 200
    for r in rows:
        x = plain_features(texts[r.doc_id])
        logit = model.intercept + sum(float(t[bisect.bisect_right(e.tolist(), v)]) for e, t, v in zip(model.edges, model.tables, x, strict=True))
        logit += sum(float(t[bisect.bisect_right(model.coarse[a].tolist(), x[a]), bisect.bisect_right(model.coarse[b].tolist(), x[b])]) for a, b, t in model.pairs)
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9) and r.predicted == (r.score >= 0.3)


def test_quality_sample_does_not_hang_on_the_order(spark):
    docs = spark.createDataFrame([(i % 60, f"text {i} " * (i % 9 + 1)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [quality_gam.learn(docs.repartition(n), labels) for n in (1, 5)]
    assert all((a == b).all() for a, b in zip(models[0].tables, models[1].tables, strict=True))


def plain_media(data):
    """Tracks, packets, clusters, cue targets of a file, by an own walk over its elements."""

    def walk(at, end):
        while at < end:
            start, wide = at, 1
            while not data[at] >> (8 - wide):
                wide += 1
            name, at = data[at : at + wide].hex(), at + wide
            wide = 1
            while not data[at] >> (8 - wide):
                wide += 1
            size = int.from_bytes(data[at : at + wide], "big") - (1 << 7 * wide)
            yield name, start, at + wide, at + wide + size
            at += wide + size

    tracks, packets, clusters, targets = 0, [], set(), set()
    for top, _, a, b in walk(0, len(data)):
        for name, start, c, d in walk(a, b) if top == "18538067" else ():
            if name == "1654ae6b":
                tracks = sum(x == "ae" for x, *_ in walk(c, d))
            elif name == "1c53bb6b":
                targets |= {int.from_bytes(data[g:h], "big") for _, _, e, f in walk(c, d) for x, _, p, q in walk(e, f) if x == "b7" for y, _, g, h in walk(p, q) if y == "f1"}
            elif name == "1f43b675":
                clusters.add(start - a)
                base = 0
                for x, _, e, f in walk(c, d):
                    if x == "e7":
                        base = int.from_bytes(data[e:f], "big")
                    elif x == "a3":
                        time, flags, at = base + int.from_bytes(data[e + 1 : e + 3], "big", signed=True), data[e + 3] & 6, e + 4
                        n = data[at] + 1 if flags else 1
                        at += bool(flags)
                        sizes = []
                        if flags == 4:
                            sizes = [(f - at) // n] * (n - 1)
                        while flags == 2 and len(sizes) < n - 1:
                            size = 0
                            while data[at] == 255:
                                size, at = size + 255, at + 1
                            sizes, at = [*sizes, size + data[at]], at + 1
                        while flags == 6 and len(sizes) < n - 1:
                            wide = 9 - data[at].bit_length()
                            v = int.from_bytes(data[at : at + wide], "big") - (1 << 7 * wide)
                            sizes.append(v if not sizes else sizes[-1] + v - (1 << (7 * wide - 1)) + 1)
                            at += wide
                        for i, size in enumerate([*sizes, f - at - sum(sizes)]):
                            packets.append((data[e] - 128, time, i, at, size))
                            at += size
    return tracks, packets, clusters, targets


def test_media_feature_is_that_of_a_plain_parse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    media = matroska.media_column(docs)
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    rows = matroska.media_features(media).collect()
    assert len(rows) >= 200
    for r in rows:
        data = files[r.doc_id]
        tracks, packets, clusters, targets = plain_media(data)
        payload = b"".join(data[a : a + n] for *_, a, n in packets)
        table = zlib.crc32(b"".join(x.to_bytes(8, "little", signed=True) for p in packets for x in p))
        mean = sum(payload) / len(payload)
        spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_bytes == len(data)
        head, _, tail = r.feature.partition(";mean=")
        assert head == f"tracks={tracks};packets={len(packets)};clusters={len(clusters)};cues={len(clusters & targets)};ms={len(payload) // 8};table={table:08x}"
        assert [float(x) for x in tail.split(";spread=")] == pytest.approx([mean, spread], abs=1e-3)


def test_damaged_media_raise_value_errors():
    rng, whole = random.Random(4), matroska.write(b"0123456789" * 800)
    for _ in range(1500):
        data = bytearray(whole[: rng.randrange(1, len(whole))] if rng.random() < 0.4 else whole)
        for _ in range(rng.randint(0, 4)):
            data[rng.randrange(min(len(data), 400) if rng.random() < 0.8 else len(data))] = rng.randrange(256)
        try:
            matroska.parse(bytes(data))
        except ValueError:
            pass


def test_warc_parts_pages_without_an_id(spark, tmp_path):
    """Pages that share an id spread over shards and files; long payloads pass; every page is read back."""
    rows = [(None if i % 2 else 5, f"u{i}", f"{i} " * 200) for i in range(400)] + [(9, "long", "x" * 5_000_000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/n", shard_bytes=20_000).collect()
    assert len({f.shard for f in manifest}) > 10 and max(f.records for f in manifest) < 100
    got = warc.read_archives(spark.createDataFrame(manifest), f"file://{tmp_path}/n").collect()
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(i), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)


def test_archives_lie_where_tables_do(spark, tmp_path):
    assert warc._qualified(spark, "s3://b/x") == "s3://b/x" and warc._qualified(spark, f"{tmp_path}/q") == f"file://{tmp_path}/q"
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    assert warc.round_trip(pages, f"{tmp_path}/q").first().page_id == 1


def test_shared_folder_must_be_named_on_a_cluster():
    from lodeline.llm.common import shared_dir

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://x/c/", "spark.master": "yarn"})) == "hdfs://x/c"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(Session(**{"spark.master": master}))
