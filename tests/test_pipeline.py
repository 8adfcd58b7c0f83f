import dataclasses
import io
import json
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import __main__ as cli
from folioflow.operators import encode, engines, state
from folioflow.plans import pipeline
from folioflow.sources import config, epub
from folioflow.streaming import incremental

XHTML = "<html xmlns='http://www.w3.org/1999/xhtml'><head><title>t</title></head><body>{}</body></html>"


def make_epub(path, title="A Book", author="Ort Vale", chapters=("One", "Two"), cover=True):
    items = "".join(f"<item id='c{i}' href='c{i}.xhtml' media-type='application/xhtml+xml'/>" for i in range(len(chapters)))
    refs = "".join(f"<itemref idref='c{i}'/>" for i in range(len(chapters)))
    points = "".join(f"<navPoint><navLabel><text>{c}</text></navLabel><content src='c{i}.xhtml#top'/></navPoint>" for i, c in enumerate(chapters))
    pic = "<item id='cover-img' href='cover.jpg' media-type='image/jpeg'/>" if cover else ""
    creator = f"<dc:creator> </dc:creator><dc:creator>{author}</dc:creator>" if author else ""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='OEBPS/content.opf'/></rootfiles></container>")
        z.writestr("OEBPS/content.opf", f"<package xmlns='http://www.idpf.org/2007/opf' xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title> {title} </dc:title>{creator}</metadata><manifest><item id='ncx' href='toc.ncx' media-type='application/x-dtbncx+xml'/>{items}{pic}</manifest><spine toc='ncx'>{refs}<itemref idref='gone'/></spine></package>")
        z.writestr("OEBPS/toc.ncx", f"<ncx xmlns='http://www.daisy.org/z3986/2005/ncx/'><navMap>{points}</navMap></ncx>")
        for i, c in enumerate(chapters):
            z.writestr(f"OEBPS/c{i}.xhtml", XHTML.format(f"<h1>{c}</h1><p>{f'Sentence {c} here. ' * 15}</p><p>Shared words.</p>"))
        if cover:
            z.writestr("OEBPS/cover.jpg", b"jpeg")
    return str(path)


@pytest.fixture
def book(tmp_path):
    return make_epub(tmp_path / "a.epub")


def test_epub_tables(spark, tmp_path, book):
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    make_epub(tmp_path / "plain.epub", title="", author="", cover=False)
    rows = {r.path.rpartition("/")[2]: r for r in epub.read_epubs(spark, str(tmp_path / "*.epub")).collect()}
    assert rows["bad.epub"].error and rows["bad.epub"].docs is None
    a, plain = rows["a.epub"], rows["plain.epub"]
    assert (a.title, a.author, bytes(a.cover), a.cover_mime) == ("A Book", "Ort Vale", b"jpeg", "image/jpeg")
    assert (plain.title, plain.author, plain.cover) == ("plain", None, None)
    assert [(t.title, t.href, t.depth) for t in a.toc] == [("One", "c0.xhtml#top", 1), ("Two", "c1.xhtml#top", 1)]
    t = epub.tables(epub.read_epubs(spark, [book, book]))
    assert t["books"].count() == 1 and t["paragraphs"].count() == 6


def test_convert_twice_speaks_once(spark, tmp_path, book):
    t = epub.tables(epub.read_epubs(spark, book))
    root = str(tmp_path / "state")
    first = pipeline.convert(spark, t, root, engines.Silence())
    assert first["missing"].count() > 0 and first["stale"].count() == 2
    n = state.clip_index(spark, root, engines.digest(engines.Silence().fingerprint())[:16]).count()
    assert n == first["missing"].count()
    text = first["vtt"].first().vtt
    assert text.startswith("WEBVTT\n\n00:00:00.000 --> ") and text.count("-->") == first["cues"].count()
    again = pipeline.convert(spark, t, root, engines.Silence())
    assert again["missing"].count() == 0 and again["stale"].count() == 0 and again["vtt"].first().vtt == text
    gaps = pipeline.timing.Gaps(sentence=0.5)
    changed = pipeline.convert(spark, t, root, engines.Silence(), gaps)
    assert changed["missing"].count() == 0 and changed["stale"].count() == 2  # new gaps, the same clips
    other = pipeline.convert(spark, t, root, engines.Tone(sample_rate=8000))
    assert other["missing"].count() == n


def test_chapter_files(spark, tmp_path, book):
    t = epub.tables(epub.read_epubs(spark, book))
    engine = engines.Tone(sample_rate=8000)
    made = pipeline.convert(spark, t, str(tmp_path / "s"), engine)
    clips = state.clips(spark, str(tmp_path / "s"), engines.digest(engine.fingerprint())[:16])
    paths = encode.chapter_wavs(made["placed"], clips, str(tmp_path / "w"), 8000)
    import wave

    sizes = {r.chapter_idx: r.samples for r in made["timeline"].collect()}
    for n, p in enumerate(paths, 1):
        with wave.open(p) as w:
            assert w.getframerate() == 8000 and w.getnframes() == sizes[n]


def test_command_line(spark, tmp_path, book, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["chapters", book]) == 0
    assert "One" in capsys.readouterr().out
    assert cli.main(["dump-text", book, "--chapter", "2", "--split"]) == 0
    out = capsys.readouterr().out
    assert "# Two" in out and "One" not in out
    assert cli.main(["dump-text", book, "--chapter", "9"]) == 1
    assert cli.main(["convert", book, "--engine", "silence", "-o", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "a-book.vtt").read_text().startswith("WEBVTT")
    assert cli.clashing([("a", "x"), ("b", "x"), ("a", "x"), ("c", "y")]) == {"x": ["a", "b"]}


def test_state_survives_repeats_and_broken_rows(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("f", "k", 8000, 2, None, b"\0\0\1\0"), ("f", "bad", 8000, 5, 5, b"\0"), ("f", "none", 8000, 0, 0, b"")], state.CLIPS.replace("clip_key", "key"))
    for _ in range(2):
        state.store_clips(rows, root)
    assert [r.clip_key for r in state.clips(spark, root, "f").collect()] == ["k"]
    assert state.clips(spark, root, "g").count() == 0 and state.manifests(spark, root, "x").count() == 0
    spark.createDataFrame([("fp", "b", 1, "{broken")], "fp string, book_id string, chapter_idx int, manifest string").selectExpr("*", "current_timestamp() written_at").write.mode("append").parquet(f"{root}/manifests")
    assert state.manifests(spark, root, "fp").count() == 0
    books = spark.createDataFrame([("b", "d1")], "book_id string, digest string")
    assert state.to_encode(books, spark, root).count() == 1
    state.stamp(books, root)
    assert state.to_encode(books, spark, root).count() == 0
    state.stamp(books.selectExpr("book_id", "'' digest"), root)
    assert state.to_encode(books, spark, root).count() == 1


def test_stream_speaks_new_texts_only(spark, tmp_path):
    src, root, cp = (str(tmp_path / x) for x in ("in", "state", "cp"))
    schema = "sent_id long, book_id string, chapter_idx int, sent_idx int, para_id long, kind string, text string"
    fp16 = engines.digest(engines.Silence().fingerprint())[:16]
    counts = []
    for texts in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(i, "b", 1, i, i, "body", t) for i, t in enumerate(texts)], schema).write.mode("append").parquet(src)
        incremental.start(spark, src, root, engines.Silence(), cp).awaitTermination()
        counts.append(spark.read.parquet(f"{root}/clips").count())
    assert counts == [2, 3] and state.clip_index(spark, root, fp16).count() == 3


def test_engines():
    assert [len(c) for c in engines.Silence().speak(["ab", "x" * 30])] == [4800, 48000]
    tone = engines.Tone(sample_rate=8000).speak(["x" * 15])[0]
    assert len(tone) == 8000 and abs(tone.max() - 0.2) < 1e-3
    pcm = engines.to_pcm16(tone)
    assert np.abs(engines.from_pcm16(pcm) - tone).max() < 1e-4
    with pytest.raises(ValueError):
        engines.from_pcm16(b"abc")
    body = (2).to_bytes(4, "little") + (4).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\0" * 6
    assert [len(c) for c in engines.segments(body, 2)] == [2, 1]
    with pytest.raises(ValueError):
        engines.segments(body, 3)
    hosted = engines.Hosted(config.HttpEngine("http://x"), "h", lambda *a: b"\0\0")
    assert len(hosted.speak(["a", "b"])) == 2
    served = engines.Served(config.BatchEngine("http://x"), "s", lambda *a: body)
    assert len(served.speak(["a", "b"], 1)) == 2
    assert engines.available() == ["silence", "tone"]
    with pytest.raises(ValueError):
        engines.create("none", config.Settings(engines={}))


def test_requests_of_services():
    make = lambda style: engines.request_of(config.HttpEngine("http://x/", style, "v", "m"), "hi", "k")
    url, body, headers = make("openai")
    assert url == "http://x/v1/audio/speech" and body["input"] == "hi" and headers["Authorization"] == "Bearer k"
    assert make("deepgram")[0].endswith("encoding=linear16&sample_rate=24000&container=none")
    assert make("elevenlabs")[2]["xi-api-key"] == "k"
    with pytest.raises(ValueError):
        make("other")


def test_local_server():
    import sys
    import urllib.error

    assert engines.longest_fitting(lambda n: n * n <= 50, 100) == 7 and engines.longest_fitting(lambda n: False, 9) == 0
    s = engines.Served(config.BatchEngine("http://x", frame_rate=10.0, context_tokens=300, voice_tokens=40), "s")
    needs = lambda n: 40 + 4 * n + s.new_tokens(n)
    assert needs(s.max_chars) <= 300 < needs(s.max_chars + 1)
    with pytest.raises(ValueError):
        _ = engines.Served(config.BatchEngine("http://x", frame_rate=10.0, context_tokens=30, voice_tokens=40), "s").max_chars
    sent = []
    answer = (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\0\0"
    s = engines.Served(config.BatchEngine("http://x", frame_rate=10.0), "s", lambda url, body, *a: sent.append(json.loads(body)) or answer)
    s.speak(["ab"]), s.speak(["ab"], 1), s.speak(["ab"], 3, capped=False)
    assert [x["seed"] for x in sent] == [0, 1, 3] and ["max_new_tokens" in x for x in sent] == [True, True, False]
    busy = [urllib.error.HTTPError("u", 409, "", {}, io.BytesIO()), b"ok"]

    def send():
        a = busy.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    waits = []
    assert engines.until_free(send, waits.append) == b"ok" and waits == [5.0]
    assert engines.start_or_adopt(["none"], "u", is_healthy=lambda u: True).process is None
    answers = iter([False, False, True])
    with engines.start_or_adopt([sys.executable, "-c", "import time; time.sleep(60)"], "u", poll_s=0.01, is_healthy=lambda u: next(answers)) as server:
        assert server.process.poll() is None
    assert server.process.poll() is not None
    with pytest.raises(RuntimeError):
        engines.start_or_adopt([sys.executable, "-c", ""], "u", poll_s=0.1, is_healthy=lambda u: False)
    with pytest.raises(RuntimeError):
        engines.start_or_adopt([sys.executable, "-c", "import time; time.sleep(60)"], "u", start_s=0.1, poll_s=0.05, is_healthy=lambda u: False)


def test_post_waits_and_gives_up():
    import urllib.error

    waits, answers = [], [urllib.error.HTTPError("u", 503, "", {"Retry-After": "7"}, io.BytesIO()), ConnectionResetError(), io.BytesIO(b"ok")]

    class Opened(io.BytesIO):
        pass

    def opener(request, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert engines.post("http://x", b"", {}, 1, opener=opener, sleep=waits.append) == b"ok" and waits == [7.0, 2.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "", {}, io.BytesIO())]
    with pytest.raises(urllib.error.HTTPError):
        engines.post("http://x", b"", {}, 1, opener=opener, sleep=waits.append)


def test_local_requests_are_not_sent_again_after_a_timeout():
    import urllib.error

    def opener(*answers):
        left = list(answers)

        def open_(request, timeout):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return open_, left

    ask = lambda o: engines.ask_local("http://x", b"", {}, 1, opener=o)
    assert ask(opener(ConnectionResetError(), io.BytesIO(b"ok"))[0]) == b"ok"
    assert ask(opener(urllib.error.URLError(ConnectionResetError()), io.BytesIO(b"ok"))[0]) == b"ok"
    for fault in (TimeoutError(), urllib.error.URLError(TimeoutError()), urllib.error.HTTPError("u", 503, "", {}, io.BytesIO())):
        o, left = opener(fault, io.BytesIO(b"ok"))
        with pytest.raises(Exception):
            ask(o)
        assert len(left) == 1
    with pytest.raises(ConnectionResetError):
        ask(opener(ConnectionResetError(), ConnectionResetError(), io.BytesIO(b"ok"))[0])


def test_waits_that_servers_ask_for():
    from datetime import UTC, datetime, timedelta
    from email.utils import format_datetime

    soon = format_datetime(datetime.now(UTC) + timedelta(seconds=20), usegmt=True)
    assert 15 < engines.retry_after(soon) <= 20 and engines.retry_after("Mon, 01 Jan 2001 00:00:00 GMT") == 0.0
    assert engines.retry_after("3") == 3.0 and engines.retry_after("900") == 60.0 and engines.retry_after("soon") is None and engines.retry_after(None) is None


def test_convert_keeps_the_best_takes_and_trims_them(spark, tmp_path):
    @dataclasses.dataclass(frozen=True)
    class Runaway:
        """A stand-in whose first takes run on: texts with ``Two`` until the second attempt, those with ``never`` as long as they are capped."""

        sample_rate: int = 8000
        max_batch: int = 2
        max_chars: int = 125
        retries: int = 2
        name: str = "runaway"

        def speak(self, texts, attempt=0, capped=True):
            def one(text):
                bad = "Two" in text and attempt < 2 or "never" in text and capped
                voice = np.full(60 * 8000 if bad else 480 * len(text) + 80 * attempt, 0.5, dtype=np.float32)
                return np.concatenate([np.zeros(4000, dtype=np.float32), voice, np.zeros(8000, dtype=np.float32)])

            return [one(t) for t in texts]

        def fingerprint(self):
            return [self.name]

    path = make_epub(tmp_path / "r.epub", chapters=("One", "Two"))
    t = epub.tables(epub.read_epubs(spark, str(path)))
    root, engine = str(tmp_path / "state"), Runaway()
    made = pipeline.convert(spark, t, root, engine)
    fp16 = engines.digest(engine.fingerprint())[:16]
    rows = made["placed"].join(state.clips(spark, root, fp16).select(F.col("clip_key").alias("key"), F.col("n_samples").alias("whole")), "key").collect()
    assert rows
    for r in rows:
        take = 480 * len(r.text) + 80 * (2 if "Two" in r.text else 0)
        assert r.whole == take + 12000 and r.n_samples == -(-take // 80) * 80 + 2 * 400  # the pad stays on both sides
    again = pipeline.convert(spark, t, root, engine)
    assert again["missing"].count() == 0 and again["stale"].count() == 0


def test_a_second_run_encodes_nothing(spark, tmp_path, book, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    calls = []

    def tool(args, progress=None):
        calls.append(args[0])
        if args[0] == "ffprobe":
            return json.dumps({"chapters": [1, 2]})
        Path(args[-1]).write_bytes(b"audio")
        if progress:
            progress(0.5), progress(1e9)
        return ""

    monkeypatch.setattr(encode, "run", tool)
    monkeypatch.setattr(cli.shutil, "which", lambda name: name)
    line = ["convert", book, "--engine", "silence", "-o", str(tmp_path / "out")]
    assert cli.main(line) == 0 and calls == ["ffmpeg", "ffmpeg"] and "100 %" in capsys.readouterr().err
    assert cli.main(line) == 0 and calls[2:] == ["ffprobe"] and "up to date" in capsys.readouterr().out
    monkeypatch.setattr(encode, "BITRATE", "64k")
    assert cli.main(line) == 0 and calls[3:] == ["ffmpeg", "ffmpeg"]
    (tmp_path / "out" / "a-book.m4b").unlink()
    assert cli.main(line) == 0 and calls[5:] == ["ffmpeg", "ffmpeg"]


def test_tools_that_fail_tell_why(tmp_path):
    import sys

    with pytest.raises(encode.EncodeError, match="no room"):
        encode.run([sys.executable, "-c", "import sys; print('out_time_us=5'); sys.exit('no room')"])
    assert encode.run([sys.executable, "-c", "print('hi')"]) == "hi\n"
    seen = []
    script = tmp_path / "tool"
    script.write_text(f"#!{sys.executable}\nprint('out_time_us=2500000')\n")
    script.chmod(0o755)
    encode.run([str(script)], seen.append)
    assert seen == [2.5]


def test_assembly_and_trimming():
    samples, at, seconds = engines.assembled([np.ones(8), np.ones(4)], [0.5, 0.26], 8)
    assert at == [(0.0, 1.0), (1.5, 2.0)] and len(samples) == 18 and seconds == 2.25
    assert engines.assembled([], [], 8)[2] == 0.1
    loud = np.concatenate([np.full(8000, 1e-4), np.ones(800), np.full(8000, 1e-4)]).astype(np.float32)
    assert len(engines.trimmed(loud, 8000)) == 800 + 2 * 400
    for odd in (np.zeros(100), np.array([np.nan] * 200), np.ones(3)):
        assert engines.trimmed(odd, 8000) is odd


def test_encode_adapter(tmp_path):
    assert encode.encode_args("a", "m", "o", 24000)[-6:] == ["aac", "-b:a", "96k", "-f", "mp4", "o"]
    assert "attached_pic" in encode.encode_args("a", "m", "o", 24000, "c.jpg")
    assert encode.settings_digest(engine="a") != encode.settings_digest(engine="b") and encode.cover_suffix("image/PNG") == ".png" and encode.cover_suffix(None) == ".jpg"
    assert encode.position("out_time_us=1500000\n") == 1.5 and encode.position("out_time_us=N/A") is None
    out, src = tmp_path / "o.m4b", tmp_path / "c.wav"
    assert not encode.is_current(out, [], 1)
    src.write_text("x"), out.write_text("x")
    assert encode.is_current(out, [src], 2, lambda p: {"chapters": [1, 2]}) and not encode.is_current(out, [src], 3, lambda p: {"chapters": [1, 2]})
    with pytest.raises(encode.EncodeError):
        encode.run(["no-such-tool"])


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("cache = 'c'\n[engines.h]\nurl = 'u'\ntimeout_s = 3\n[engines.b]\nurl = 'u'\nmax_batch = 2\n")
    s = config.load(str(f))
    assert s.engines["h"].timeout_s == 3.0 and s.engines["b"].max_batch == 2 and engines.available(s) == ["b", "h", "silence", "tone"]
    assert config.load(None, {}).cache == "cache" and config.config_path(None, {config.VARIABLE: "x"}) == (config.Path("x"), True)
    for bad in ("x = 1", "cache = 3", "[engines.h]\nvoice = 'x'", "[engines.h]\nurl = 'u'\nconcurrency = true", "[engines.h]\nurl = 'u'\nodd = 1", "= ="):
        f.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(f))
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "gone.toml"))
