import hashlib
import io
import random

import duckdb
import pytest

from sourceloom.llm import chat_format as cf, link_trust as lt, warc_archive as wa


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def page_rows():
    big, other = "<p>" + "same payload é " * 20, "x" * 99
    return [
        (5, "http://a.org/x", big), (3, "http://b.org/y", big), (9, "weird\r\nurl", big), (4, None, big), (None, "http://c.org", big),
        (6, "http://a.org/1", other), (7, "http://a.org/2", other), (8, "u", None), (10, "u", ""), (3, "http://b.org/y", big), (11, "http://z.de/", "y" * 100), (12, "http://z.de/", "y" * 100),
    ]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in page_rows()], "page_id long, url string, html string, digest string, original int")
    first = {}
    for p, _, h in page_rows():
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in page_rows():
        raw = (h or "").encode()
        again = h in first and p != first[h]
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for few in (wa.BROADCAST_ROWS, 0):
        wa.BROADCAST_ROWS, kept = few, wa.BROADCAST_ROWS
        got = wa.round_trip(df.repartition(3))
        assert rows_of(got, columns) == sorted(want, key=str)
        assert {r.page_id: r.payload for r in got.collect() if r.record_type == "response"}[11] == b"y" * 100
        wa.BROADCAST_ROWS = kept
    assert wa.round_trip(df.limit(0)).count() == 0
    files = wa.write_archives(df.repartition(2), str(tmp_path / "w"), file_bytes=300)
    assert files.count() > 4 and sum(r.records for r in files.collect()) == len(page_rows())


def test_warc_headers_and_resolving(spark, tmp_path):
    df = spark.createDataFrame([(p, u, h) for p, u, h in page_rows()] + [(20, "http://x/a%20b", "z" * 300), (21, "http://x/a%2520b", "z" * 300), (2, "http://q/", "q")], "page_id long, url string, html string")
    folder = str(tmp_path / "a")
    # revisits come before their responses, and in other files
    files = wa.write_archives(df.repartition(5).sortWithinPartitions(df.page_id.desc()), folder, file_bytes=400, date="2024-01-31T00:00:00Z")
    rows = wa.read_archives(files, folder).collect()
    assert len({r.record_id for r in rows}) == len(rows) == df.count() and {r.date for r in rows} == {"2024-01-31T00:00:00Z"}
    assert {r.page_id: r.url for r in rows if r.page_id in (4, 9, 20, 21)} == {4: None, 9: "weird%0D%0Aurl", 20: "http://x/a%20b", 21: "http://x/a%2520b"}
    html = {p: (h or "").encode() for p, _, h in map(tuple, df.collect())}
    full = wa.resolve(files, folder).collect()
    assert len(full) == len(rows) and all(r.payload == html[r.page_id] for r in full)
    heads = {}
    for name in sorted(f.file for f in files.collect()):
        with open(f"{folder}/{name}", "rb") as source:
            for raw in wa.members(source):
                h, _ = wa.parse(raw)
                heads[h["warc-record-id"]] = h
    revisits = [h for h in heads.values() if h["warc-type"] == "revisit"]
    assert len(revisits) > 4
    for h in revisits:
        first = heads[h["warc-refers-to"]]
        assert first["warc-type"] == "response" and first["warc-payload-digest"] == h["warc-payload-digest"] and first["warc-date"] == h["warc-refers-to-date"]
        assert first.get("warc-target-uri") == h.get("warc-refers-to-target-uri")


def test_warc_merge(spark, tmp_path):
    schema, one, two, out = "page_id long, url string, html string", str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "out")
    first = spark.createDataFrame([(5, "http://a/", "k" * 200), (6, "http://b/", "k" * 200), (7, "http://c/", "short")], schema)
    more = spark.createDataFrame([(2, "http://d/", "k" * 200), (8, "http://e/", "m" * 150)], schema)
    a = wa.write_archives(first, one, date="2023-01-01T00:00:00Z").collect()
    b = wa.write_archives(more, two, date="2024-01-01T00:00:00Z").collect()
    (tmp_path / "both").mkdir()
    names = []
    for k, (folder, rows) in enumerate(((one, a), (two, b))):
        for r in rows:
            names.append((f"{k}-{r.file}", r.records))
            (tmp_path / "both" / names[-1][0]).write_bytes((tmp_path / folder / r.file).read_bytes())
    files = wa.merge(spark.createDataFrame(names, "file string, records long"), str(tmp_path / "both"), out)
    got = {r.page_id: r for r in wa.read_archives(files, out).collect()}
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {2: ("response", None), 5: ("revisit", 2), 6: ("revisit", 2), 7: ("response", None), 8: ("response", None)}
    # page 5 had the payload, 6 only named it: 6 alone keeps nothing, but its response is found in the merged archives
    assert {r.page_id: r.payload for r in wa.resolve(files, out).collect()} == {2: b"k" * 200, 5: b"k" * 200, 6: b"k" * 200, 7: b"short", 8: b"m" * 150}
    assert {p: r.date[:4] for p, r in got.items()} == {2: "2024", 5: "2023", 6: "2023", 7: "2023", 8: "2024"}


def one_record(page, payload, **more):
    row = dict(page_id=page, url="http://x/", date="2024-01-01T00:00:00Z", payload=payload, n=len(payload), digest="0" * 64, place=None, revisit=False, before=None, http=None, label=None)
    return wa.record({**row, **more})


def foreign(kind, rid, payload=b"", uri=None, date="2020-01-01T00:00:00Z", http=b"HTTP/1.1 404 Not Found\r\nX-Kept: yes\r\nTransfer-Encoding: identity", **more):
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: {date}"] + [f"WARC-Target-URI: {uri}"] * bool(uri) + [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    block = http + b"\r\n\r\n" + payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    import base64
    import gzip

    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    big, other = b"<p>same</p>" * 30, b"other page " * 40
    first = [
        foreign("revisit", "r1", uri="http://x/1", WARC_Refers_To="<urn:uuid:a1>"), foreign("revisit", "r2", uri="http://x/2", WARC_Refers_To_Target_URI="http://a/1", WARC_Refers_To_Date="2019-05-05T00:00:00Z"),
        foreign("revisit", "r3", uri="http://x/3", WARC_Payload_Digest=sha1(other)), foreign("revisit", "r4", uri="http://x/4", WARC_Payload_Digest="sha1:NOWHERE"), foreign("warcinfo", "w"),
    ]
    second = [
        foreign("response", "a1", big, "http://a/1", "2019-05-05T00:00:00Z", WARC_Payload_Digest=sha1(big)), foreign("response", "a2", other, "http://a/2", WARC_Payload_Digest=sha1(other)), foreign("response", "a3", big, "http://a/3", WARC_Payload_Digest=sha1(big)),
        foreign("response", "a4", b"short", "http://a/4"), foreign("response", "a5", b"short", "http://a/5"),
    ]
    (tmp_path / "in").mkdir()
    for name, records in (("1.warc.gz", first), ("2.warc.gz", second)):
        (tmp_path / "in" / name).write_bytes(b"".join(map(gzip.compress, records)))
    files = spark.createDataFrame([("1.warc.gz", 5), ("2.warc.gz", 5)], "file string, records long")
    urls = {f"http://x/{i}": p for i, p in ((1, big), (2, big), (3, other), (4, None))} | {f"http://a/{i}": p for i, p in ((1, big), (2, other), (3, big), (4, b"short"), (5, b"short"))}
    assert {r.url: r.payload for r in wa.resolve(files, str(tmp_path / "in")).collect()} == urls
    out = str(tmp_path / "out")
    merged = wa.merge(files, str(tmp_path / "in"), out)
    read = {r.url: r for r in wa.read_archives(merged, out).collect()}
    assert {u: r.record_type for u, r in read.items()} == {"http://a/1": "response", "http://a/2": "response", "http://a/3": "revisit", "http://a/4": "response", "http://a/5": "response"} | {f"http://x/{i}": "revisit" for i in (1, 2, 3, 4)}
    assert len({r.record_id for r in read.values()}) == 9 and all(r.http.startswith(b"HTTP/1.1 404 Not Found\r\nX-Kept: yes") and r.page_id is None for r in read.values())
    assert {read[f"http://{u}"].refers_id for u in ("a/3", "x/1", "x/2")} == {read["http://a/1"].record_id} and read["http://x/3"].refers_id == read["http://a/2"].record_id
    assert read["http://x/4"].label == "sha1:NOWHERE" and read["http://x/4"].refers_id is None
    assert {r.url: r.payload for r in wa.resolve(merged, out).collect()} == urls
    again = wa.merge(merged, out, str(tmp_path / "again"))  # merging once more changes no type and loses nothing
    assert {r.url: (r.record_type, r.payload) for r in wa.resolve(again, str(tmp_path / "again")).collect()} == {u: (read[u].record_type, p) for u, p in urls.items()}


def test_warc_members_and_faults():
    import gzip

    raw = [one_record(i, b"a" * n) for i, n in enumerate((0, 5, 70_000))]
    data = b"".join(gzip.compress(r) for r in raw)
    for size in (7, 1 << 20):
        assert list(wa.members(io.BytesIO(data), size)) == raw
    with pytest.raises(ValueError):
        list(wa.members(io.BytesIO(data[:-9])))
    headers, block = wa.parse(raw[1])
    assert block.endswith(b"aaaaa") and headers["warc-type"] == "response"
    with pytest.raises(ValueError):
        wa.parse(raw[1][:-1])
    with pytest.raises(ValueError):
        wa._fields(raw[1], "file")  # its digest isn't the payload's
    other = b"WARC/1.0\r\nwarc-type:request\r\ncontent-length: 3\r\n\r\nGET\r\n\r\n"
    assert wa._fields(other, "file") is None
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 16\r\n\r\nHTTP/1.1 200\r\n\r\n\r\n\r\n"
    assert wa._fields(bare, "file")[1:4] == (0, hashlib.sha256(b"").hexdigest(), "response")


def plain_judge(rows, steps=400, d=lt.DAMPING):
    import re

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.split(r"[?#]", rest[len(host):])[0]

    out, seeds, edges = [], {}, {}
    for p, u, h in rows:
        host, path = parts(u)
        fit = [(len(t), says, t) for says, t in lt.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        best = max(fit, default=(0, None, None))
        out.append((p, host, path, best[2], best[1]))
        if best[1]:
            k = "trust" if best[1] == "allow" else "distrust"
            seeds[k, host] = seeds.get((k, host), 0) + 1
        for link in re.findall(r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)", h or ""):
            if host and link.lower() != host:
                edges[host, link.lower()] = edges.get((host, link.lower()), 0) + 1
    score = {}
    for kind in ("trust", "distrust"):
        moves = [((a, b) if kind == "trust" else (b, a), n) for (a, b), n in edges.items()]
        total = {}
        for (a, _), n in moves:
            total[a] = total.get(a, 0) + n
        start = {h: n / sum(m for (k, _), m in seeds.items() if k == kind) for (k, h), n in seeds.items() if k == kind}
        rank = dict(start)
        for _ in range(steps if edges else 0):
            new = {h: (1 - d) * s for h, s in start.items()}
            for (a, b), n in moves:
                if a in rank:
                    new[b] = new.get(b, 0) + d * n / total[a] * rank[a]
            rank = new
        score[kind] = rank if edges else {h: (1 - d) * s for h, s in start.items()}
    return sorted(((p, h, x, r, v or ("block" if score["distrust"].get(h, 0) > score["trust"].get(h, 0) else "allow")) for p, h, x, r, v in out), key=str)


def judged_rows():
    rng = random.Random(8)
    hosts = ["a.example.org", "www.example.org", "news.com", "Shop.Com", "spam.net", "friend.net", "plain.net", "evil.com"]
    rows = [(1, None, None), (2, "no scheme", "<a href='//x.org/'>"), (3, "http://", ""), (4, "x://ORG/", None), (5, "http://news.com/de/1?x=/fr/", ""), (6, "http://news.com?de", ""), (7, "http://org", ""), (8, "a://b://c/d", "")]
    for i in range(120):
        h = rng.choice(hosts)
        links = "".join(f'<a data-href="http://{rng.choice(hosts)}/q" class=x href="http://{rng.choice(hosts)}/p">l</a>' for _ in range(rng.choice([0, 1, 3])))
        rows.append((10 + i, f"https://{h}{rng.choice(['/es/', '/en/1', '/en/2', '/fr/x', '/de/y#z', '', '/?q'])}", links))
    return rows


def test_link_trust_matches_brute_force_and_sql(spark):
    schema, columns = "page_id long, url string, html string, host string, seed double", ["page_id", "host", "path", "rule", "verdict"]
    for rows in (judged_rows(), judged_rows()[:9], page_rows()):
        df = spark.createDataFrame([(p, u, h, "clash", 0.5) for p, u, h in rows], schema)
        got = rows_of(lt.judge(df), columns)
        assert got == plain_judge(rows)
        con = duckdb.connect()
        pages = df.select("page_id", "url", "html").toPandas()  # noqa: F841
        con.execute("CREATE TABLE pages AS SELECT page_id::BIGINT AS page_id, url, html FROM pages")
        assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({lt.judge_sql()})").fetchall(), key=str) == got
    assert {r.verdict for r in lt.judge(spark.createDataFrame([(p, u, h, "c", 0.5) for p, u, h in judged_rows()], schema)).collect()} == {"allow", "block"}
    assert lt.judge(df.limit(0)).count() == 0


def test_trust_spreads_to_its_end(spark):
    rng = random.Random(9)
    chain = ["evil.com", *(f"h{i}.net" for i in range(23))]
    rows = [(1, "http://evil.com/de/", ""), (2, "http://good.com/fr/", "<a href='http://far.net/'>")]
    rows += [(10 + i, f"http://{b}/", f"<a href='http://{a}/'>") for i, (a, b) in enumerate(zip(chain[:-1], chain[1:], strict=True))]
    many = [f"m{i}.net" for i in range(40)] + ["evil.com", "good.com"]
    rows += [(100 + i, f"http://{h}/", "".join(f"<a href='http://{rng.choice(many)}/'>" for _ in range(2))) for i, h in enumerate(many * 2)]
    got = rows_of(lt.judge(spark.createDataFrame(rows, "page_id long, url string, html string")), ["page_id", "host", "path", "rule", "verdict"])
    assert got == plain_judge(rows)
    assert got != plain_judge(rows, steps=10)  # ten steps are not enough here
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({lt.judge_sql()})").fetchall(), key=str) == got
    assert {v for _, h, _, _, v in got if h == chain[-1]} == {"block"}


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi \\ <s>[INST] \\n"), (1, 2, "assistant", " x </s> <\\/s> <|reply|> \n"), (2, 0, "assistant", "first [INST] <s> [/INST] <<SYS>> <</SYS>> <<ROLE"), (2, 1, "user", None), (2, 2, "user", ""),
    (3, 0, None, "none"), (3, 1, "to<<TEXT>>ol", "<</ROLE>> é 😀"), (None, 0, "user", "null"), (4, None, "assistant", "late"), (4, 0, "user", "early"), (4, 0, "user", "early"),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*r, True, "x") for r in CHATS], "conv_id long, turn long, role string, text string, loss boolean, part string")
    segments = cf.format_chats(df)
    got = {r.conv_id: r for r in cf.digests(segments).collect()}
    texts = {r.text for r in segments.collect() if r.part == 1}
    assert not any(m in t for m in cf.TEMPLATE.marks() for t in texts)
    assert all(cf.unescape(cf.escape(t or "", cf.TEMPLATE.pattern())) == (t or "") for *_, t in CHATS)
    for conv in {r[0] for r in CHATS}:
        turns = sorted((r for r in CHATS if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(r.text) for r in segments.where(segments.conv_id.eqNullSafe(conv)).collect())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert cf.digests(cf.format_chats(df.limit(0))).count() == 0


def test_chat_sql_on_odd_texts(spark):
    con = duckdb.connect()
    conversations = spark.createDataFrame([r for r in CHATS if r[0] is not None], "conv_id long, turn long, role string, text string")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in CHATS if r[0] is not None])
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({cf.sql()})").fetchall(), key=str)
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], conversations.schema)
    assert rows_of(cf.digests(cf.format_chats(conversations.unionByName(more))), names) == want


def test_chat_text_in_pieces():
    template, pattern = cf.TEMPLATE, cf.TEMPLATE.pattern()
    turns = [("user", "a [/INST] b\\"), ("assistant", " </s>\n x"), ("odd <<TEXT>>", "<</ROLE>>"), ("system", ""), ("assistant", "")]
    whole = "".join(t for r, x in turns for t, _ in cf.segments_of(r, x, template, pattern))
    for size in (1, 3, 1000):
        reader, got = cf.Reader(template), []
        for i in range(0, len(whole), size):
            got += [(r, x) for r, x, _, _ in reader.feed(whole[i : i + size])]
        assert got == turns and reader.held == "" and reader.at == len(whole)
    with pytest.raises(ValueError):
        list(cf.Reader(template).feed("no turn of this template"))
    # spans may be cut anywhere: only the text and the mask count
    digest = cf._Digest(template)
    for piece, trained in (("<s>[INST] hi [/INS", False), ("T]<|reply|> ", False), ("an", True), ("swer", True), (" </s>\n", False)):
        digest.add(piece, trained, True)
    assert digest.row(7)[1:5] == (2, hashlib.sha256(b"user\nhi\nassistant\nanswer\n").hexdigest(), 6, hashlib.sha256(b"answer").hexdigest())
