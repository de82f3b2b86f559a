"""Keys in the forms in which they are stored, beside the plain runs of test_text_operators."""

import base64
import random
import time

import pytest
from test_text_operators import der, found, keys, number

from motionmatch.llm import structures


def base64_of(data):
    return base64.b64encode(data).decode()


def lines(run, size=64, end="\n"):
    return end.join(run[k:k + size] for k in range(0, len(run), size))


@pytest.mark.parametrize("name", ["rsa", "pkcs8", "sec1", "ssh"])
def test_keys_are_found_in_every_form(name):
    data = keys(random.Random(9))[name]
    kind, run = "ssh_key" if name == "ssh" else "der_key", base64_of(data)
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines(run)}\n-----END PRIVATE KEY-----\n"
    assert found(f"key: {base64_of(pem.encode())} end") == [(kind, base64_of(pem.encode()))]
    assert found(f"tls.key={base64_of(pem.encode())}") == [(kind, base64_of(pem.encode()))]
    assert found(f"double {base64_of(run.encode())} end") == [(kind, base64_of(run.encode()))]
    assert found(f"see 0x{data.hex()} there") == [(kind, data.hex())]
    assert found(f"see 0X{data.hex().upper()},") == [(kind, data.hex().upper())]
    for joiner in ("prod-key-", "deploy_key_", "path/to/key/", "x"):
        assert found(f"see {joiner}{run} there") == [(kind, run)]
        assert found(f"see {joiner}{data.hex()} there") == [(kind, data.hex())] or joiner == "x"
        url = base64.urlsafe_b64encode(data).decode()
        assert found(f"see {joiner}{url} there") == [(kind, url)]
    for size, end in ((64, "\n"), (76, "\r\n"), (64, "\\n"), (48, "\n    ")):
        assert found(f"private: {lines(run, size, end)}\nmore words") == [(kind, lines(run, size, end))]
    text = f"a {base64_of(pem.encode())} b prod-{run} c 0x{data.hex()} d"
    clean = structures.masked(text, structures.secrets_in(text))
    assert run[8:40] not in clean and data.hex()[8:40] not in clean and base64_of(pem.encode())[40:80] not in clean


def test_other_content_stays_in_every_form():
    rng = random.Random(11)
    text = " ".join(rng.choices("plain words of a longer text that is no key at all".split(), k=200)).encode()
    for data in (rng.randbytes(3000), text, base64.b64encode(rng.randbytes(900)), b"0" * 200, b"\x30\x82\x01\x0a" * 60):
        run = base64_of(data)
        for form in (run, f"name-{run}", f"0x{data.hex()}", lines(run), base64_of(run.encode())):
            assert found(f"see {form} there") == []


def old_pem(rng, cipher="AES-128-CBC", vector=16, size=1232, header="Proc-Type: 4,ENCRYPTED", end="\n"):
    return (f"-----BEGIN RSA PRIVATE KEY-----{end}{header}{end}DEK-Info: {cipher},{rng.randbytes(vector).hex().upper()}{end}{end}"
            f"{lines(base64_of(rng.randbytes(size)), end=end)}{end}-----END RSA PRIVATE KEY-----")


def test_encrypted_keys_of_the_old_form():
    rng = random.Random(12)
    for end in ("\n", "\r\n", "\\n"):
        for cipher, vector in (("AES-128-CBC", 16), ("DES-EDE3-CBC", 8)):
            pem = old_pem(rng, cipher, vector, end=end)
            assert found(f"see {pem} there") == [("der_key", pem)]
    pem = old_pem(rng)
    assert found(f"see {base64_of(pem.encode())} there") == [("der_key", base64_of(pem.encode()))]
    for other in (old_pem(rng, vector=8), old_pem(rng, size=1233), old_pem(rng, header="Comment: none"),
                  old_pem(rng).replace("PRIVATE KEY", "MESSAGE"), old_pem(rng, cipher="ROT13")):
        assert found(f"see {other} there") == []


def dsa(rng, bits=1024, middle=160, fields=6):
    return der(0x30, der(2, b"\0"), number(rng, bits), number(rng, middle), *(number(rng, bits) for _ in range(fields - 4)),
               number(rng, middle))


def test_dsa_keys():
    rng = random.Random(13)
    data = dsa(rng)
    run = base64_of(data)
    pem = f"-----BEGIN DSA PRIVATE KEY-----\n{lines(run)}\n-----END DSA PRIVATE KEY-----"
    assert found(f"see {run} there") == [("der_key", run)] and found(f"see {pem} there") == [("der_key", pem)]
    assert found(f"see {data.hex()} there") == [("der_key", data.hex())]
    for other in (dsa(rng, fields=5), dsa(rng, middle=1024), dsa(rng, bits=256)):
        assert found(f"see {base64_of(other)} there") == []


def test_wrapped_and_plain_keys_of_one_run():
    rng = random.Random(14)
    plain, other = (base64_of(dsa(rng)).rstrip("=") for _ in range(2))
    wrapped = base64_of(other.encode()).rstrip("=")
    assert found(f"see {plain}/{wrapped} there") == [("der_key", plain), ("der_key", wrapped)]
    noise = base64_of(rng.randbytes(700)).rstrip("=")
    assert found(f"see {plain}/{noise} there") == [("der_key", plain)]


def test_many_key_starts_cost_little():
    """Each start claims a megabyte; none has the first field of a key."""
    run = base64_of(b"\x30\x83\x02\x00\x00\x30\x83" * 60_000)
    began = time.perf_counter()
    assert found(f"see {run} there") == []
    assert time.perf_counter() - began < 5
