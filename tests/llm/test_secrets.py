import hashlib
import random
import re

from quarry.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], S.KINDS.index(x[2])))


def test_base_spans_equal_plain_regexes():
    rnd = random.Random(5)
    parts = ["token", "TOKEN=", "password: ", "api_key", "apiKey='", "secret", "=", ":", '"', "abcdefgh", "x", " ", "AKIA", "AKIA0123456789AB",
             "0a" * 15, "0a" * 16, "f" * 33, "é", "İ", "K", "\n", "passwd", "zz", "d", "A9"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert [s for s in S.find_secrets(t) if s[2] in S.BASE_KINDS] == brute(t), t


def test_checksummed_tokens():
    body = "0123456789abcdefghijABCDEFGHIJ"
    good = "ghp_" + body + S.checksum(body)
    assert (2, 2 + len(good), "github") in S.find_secrets("x " + good + " y")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert not any(k == "github" for *_, k in S.find_secrets("x " + bad))
    assert any(k == "npm" for *_, k in S.find_secrets("npm_" + body + S.checksum(body)))


def test_scan_rows(spark):
    rows = [(1, "password = hunter2hunter2", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "a" * 100_000 + "0" * 40, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    out = S.scan_secrets(df).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].spans == "assign:0:25" and by[1].n_assign == 1
    assert by[2].base_sha256 == hashlib.sha256(b"").hexdigest() == by[3].base_sha256
    assert by[None].n_hex == 1 and by[None].spans == "hex:0:100040"
    assert S.scan_secrets(df.limit(0)).count() == 0
