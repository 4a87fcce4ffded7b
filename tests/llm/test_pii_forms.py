from veldrift.llm import pii

from .cases import frame


def test_long_secrets_and_plain_phones(spark):
    secret = "Ab9_" * 75
    forms = ["+14155550132", "+1 415 555 0132", "415-555-0132", "(415) 555-0132", "+1-415-555-0132"]
    rows = [(i, f"call {v} now", "en", "s", 0, "c", 1, "v", 1) for i, v in enumerate(forms)]
    rows += [(50, f"token={secret} end", "en", "s", 0, "c", 1, "v", 1), (51, f"token={secret[:199]}", "en", "s", 0, "c", 1, "v", 1)]
    out = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows), "k").collect()}
    digits = lambda i: "".join(c for c in out[i].text if c.isdigit())[-10:]
    assert all(out[i].n_phone == 1 and forms[i] not in out[i].text for i in range(5))
    assert len({digits(i) for i in range(5)}) == 1 and digits(0) != "4155550132"
    assert out[0].text.startswith("call +1") and out[0].text.endswith(" now")
    assert out[50].n_secret == 1 and "Ab9_" not in out[50].text and len(out[50].text) == 310
    assert out[51].n_secret == 1 and "Ab9_" not in out[51].text and len(out[51].text) == 205
