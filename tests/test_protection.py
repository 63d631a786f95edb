"""Keys, envelopes and destinations."""

import hashlib
import os

import pytest

from quillrec.errors import ProtectionError
from quillrec.functions import mlkem
from quillrec.sources import protect
from tests import kem_vector


@pytest.fixture(scope="module")
def keys(tmp_path_factory):
    folder = tmp_path_factory.mktemp("keys")
    for name in ("a", "b"):
        (folder / name).mkdir()
        assert protect.generate_keypair(folder / name)["warnings"] == []
    return folder


def test_kem():
    public, secret = mlkem.generate(bytes(64))
    assert (len(public), len(secret)) == (1184, 2400) and mlkem.valid_public(public) and mlkem.valid_secret(secret)
    shared, sealed = mlkem.encapsulate(public)
    assert mlkem.decapsulate(secret, sealed) == shared != mlkem.decapsulate(secret, sealed[:-1] + bytes([sealed[-1] ^ 1]))
    assert not mlkem.valid_public(b"\xff" * 1184) and not mlkem.valid_secret(secret[:2360] + bytes([secret[2360] ^ 1]) + secret[2361:])


def test_interoperability(spark, tmp_path):
    public, secret = mlkem.generate(bytes.fromhex(kem_vector.SEED))
    sealed = bytes.fromhex(kem_vector.CIPHERTEXT)
    assert hashlib.sha256(public).hexdigest() == kem_vector.PUBLIC_SHA256
    assert mlkem.decapsulate(secret, sealed).hex() == kem_vector.SHARED
    header = protect.Header(len(kem_vector.PLAINTEXT), hashlib.sha256(public).digest(), kem_vector.SALT, kem_vector.NONCE_PREFIX, sealed)
    (tmp_path / "k").write_bytes(protect.encode_key(secret, True))
    (tmp_path / "e").write_bytes(header.encode() + bytes.fromhex(kem_vector.FRAME))
    protect.unprotect_file(spark, tmp_path / "e", tmp_path / "k", tmp_path / "out")
    assert (tmp_path / "out").read_bytes() == kem_vector.PLAINTEXT


C = protect.FRAME


@pytest.mark.parametrize("size", [0, 1, C - 1, C, C + 1, 3 * C + 17])
def test_round_trip(spark, keys, tmp_path, size):
    data = os.urandom(min(size, 999)) * (size // 999 + 1)
    (tmp_path / "in").write_bytes(data[:size])
    protect.protect_file(spark, tmp_path / "in", keys / "a/public.key", tmp_path / "sealed")
    assert (tmp_path / "sealed").stat().st_size == protect.envelope_size(size) == 1179 + size + 16 * max(1, -(-size // C))
    protect.unprotect_file(spark, tmp_path / "sealed", keys / "a/secret.key", tmp_path / "out")
    assert (tmp_path / "out").read_bytes() == data[:size]
    with pytest.raises(ProtectionError) as e:
        protect.unprotect_file(spark, tmp_path / "sealed", keys / "b/secret.key", tmp_path / "other")
    assert e.value.kind == "RecipientFingerprintMismatch" and str(e.value) == "M5 authentication/unprotection failed"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out", "sealed"]


def test_tampering(spark, keys, tmp_path):
    (tmp_path / "in").write_bytes(os.urandom(2 * C + 5))
    protect.protect_file(spark, tmp_path / "in", keys / "a/public.key", tmp_path / "sealed")
    good = (tmp_path / "sealed").read_bytes()
    step = C + 16
    one, two, last = good[1179 : 1179 + step], good[1179 + step : 1179 + 2 * step], good[1179 + 2 * step :]
    flip = lambda at: good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    cases = [flip(0), flip(9), flip(11), flip(19), flip(25), flip(60), flip(85), flip(1000), flip(1179), flip(1179 + step + 7), flip(len(good) - 1),
             good[:1179] + two + one + last, good[:1179] + one + one + last, good[:1179] + one + last, good[:1179], *(good[:n] for n in (0, 1, 7, 11, 1178))]
    for i, data in enumerate(cases):
        (tmp_path / "bad").write_bytes(data)
        with pytest.raises(ProtectionError):
            protect.unprotect_file(spark, tmp_path / "bad", keys / "a/secret.key", tmp_path / f"out{i}")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad", "in", "sealed"]


def test_declared_lengths_come_before_the_key(spark, tmp_path):
    for declared, kind in ((2**52, "InvalidLength"), (2**64 - 1, "InputTooLarge")):
        (tmp_path / "e").write_bytes(protect.Header(declared, bytes(32), bytes(32), bytes(7), bytes(1088)).encode())
        with pytest.raises(ProtectionError) as e:
            protect.unprotect_file(spark, tmp_path / "e", tmp_path / "no key", tmp_path / "o")
        assert e.value.kind == kind


def test_key_files(spark, keys, tmp_path):
    good = (keys / "a/public.key").read_bytes()
    (tmp_path / "in").write_bytes(b"x")
    assert (keys / "a/secret.key").stat().st_mode & 0o777 == 0o600
    for data in (good[:-1], good + b"x", b"X" + good[1:], good[:8] + b"\0\2" + good[10:], good[:10] + b"\0\2" + good[12:], good[:15] + b"\1" + good[16:], good[:16] + b"\xff" * 1184):
        (tmp_path / "k").write_bytes(data)
        with pytest.raises(ProtectionError):
            protect.protect_file(spark, tmp_path / "in", tmp_path / "k", tmp_path / "o")
    with pytest.raises(ProtectionError, match="already exists"):
        protect.generate_keypair(keys / "a")
    (tmp_path / "half").mkdir()
    (tmp_path / "half/secret.key").write_text("mine")
    with pytest.raises(ProtectionError):
        protect.generate_keypair(tmp_path / "half")
    assert (tmp_path / "half/public.key").exists() and (tmp_path / "half/secret.key").read_text() == "mine"


def test_destinations(tmp_path):
    for bad in (tmp_path / ".." / "x", tmp_path / "no" / "x", tmp_path / "a:b", tmp_path / "a.", tmp_path / f"{protect.STAGING}x"):
        with pytest.raises(ProtectionError):
            protect.checked_destination(bad)
    (tmp_path / "link").symlink_to(tmp_path)
    with pytest.raises(ProtectionError, match="symlinks"):
        protect.checked_destination(tmp_path / "link" / "x")
    for i, (name, text) in enumerate((
        (".m4.lock", ""), (".manifest.json.tmp", ""), ("complete.json", '{"version":1}'), ("manifest.json", '{"format":"quillrec-parts"}'), ("manifest.json", "{"), ("manifest.json", "[]"))):
        folder = tmp_path / f"job{i}" / "deep"
        folder.mkdir(parents=True)
        (folder.parent / name).write_text(text)
        with pytest.raises(ProtectionError):
            protect.checked_destination(folder / "x")
    (tmp_path / "manifest.json").write_text('{"name":"app"}')
    assert protect.checked_destination(tmp_path / "x") == tmp_path / "x"


def test_frame_plan():
    assert [protect.frame_count(n) for n in (0, 1, C, C + 1)] == [1, 1, 1, 2]
    with pytest.raises(ProtectionError):
        protect.frame_count(2**52 + 1)
    assert protect.nonce(b"1234567", 258, True) == b"1234567\0\0\1\2\1"
