import hashlib
import re

from opsmill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for order, (kind, pattern) in enumerate([("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)]):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def noise(rng):
    bits = [
        "a.b@c.de", "x@y", "a@b.c@d.e", "a@b.cd%x@y.z", "@", "%+", ".", "-", " ", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0255.01.1.000000",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1-2", "+", "12", "7", "é", "😀", "word", "Name", "\n", "(", ")",
        "99999999999999999999.1.1.1", "378282246310005", "000000000000", "+123456789012345678",
    ]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))


def test_base_spans(make_docs, rng):
    rows = [(k, noise(rng)) for k in range(1500)]
    rows += [(5000, None), (5001, ""), (None, "a@b.cd"), (7, rows[7][1]), (5002, "1" * 30_000), (5003, "a" * 200_000 + " x@y.zz")]
    rows += [(5004, "4 1" * 9000), (5005, "1.2.3.4 " * 500), (5006, "+1" + "-" * 20_000), (5007, "a@" + "b." * 20_000)]
    found = pii.protected_spans(make_docs(rows)).select("doc_id", pii._listed(pii.F.col("base")).alias("base")).collect()
    assert sorted(((r.doc_id, r.base) for r in found), key=repr) == sorted(((i, listed(brute(t))) for i, t in rows), key=repr)


def test_terms_that_disclose(make_docs, sentence):
    rows = [(k, f"{sentence(30)} Quentin wrote to q.tar@ex.org from place{k} word {sentence(30)}") for k in range(6)]
    rows += [(100 + k, f"word {sentence(40)}") for k in range(200)]
    rows += [(400 + k, "Rosalind has r@ex.org in one copied passage") for k in range(30)]
    rows += [(500, "Quentin alone"), (501, None)]
    docs = make_docs(rows)
    spans = {r.doc_id: [tuple(s)[:3] for s in r.spans] for r in pii.protected_spans(docs).collect()}
    for k in range(6):
        terms = [rows[k][1][a:b] for a, kind, b in spans[k] if kind == 4]
        assert set(terms) == {"Quentin", "wrote", "from", "place"}  # but not "word", which is everywhere
    assert spans[400] == [(13, 0, 21)]  # one surrounding proves nothing
    assert spans[500] == [] and spans[501] == []
    texts = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert "Quentin" not in texts[0] and "[EMAIL]" in texts[0] and "[TERM]" in texts[0] and " word " in texts[0]
    assert texts[400] == "Rosalind has [EMAIL] in one copied passage" and texts[500] == "Quentin alone" and texts[501] is None


def test_digests(spark, make_docs, tmp_path):
    rows = [(1, "b@c.de 1.2.3.4"), (2, None)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in pii.op8(spark, str(tmp_path)).collect()}
    assert found[1].spans == "email:0:6,ip:7:14" and (found[1].n_email, found[1].n_ip, found[1].n_card) == (1, 1, 0)
    assert found[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert found[2].spans == "" and found[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty(make_docs):
    assert pii.protected_spans(make_docs([])).collect() == [] and pii.sanitised(make_docs([])).collect() == []
