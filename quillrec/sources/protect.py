"""Optional, experimental file protection: ML-KEM-768, HKDF-SHA-256 and AES-256-GCM over 1 MiB frames.

Frames are independent (a frame's nonce depends on its number alone), so they are sealed and opened in parallel by Spark's own
aes_encrypt and aes_decrypt. Frame sizes are fixed, so each task writes to its place in one staged file, which the driver
publishes only when every frame is done. Files are on a POSIX file system that driver and executors share.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import re
import secrets
import stat
import struct
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillrec.errors import ProtectionError
from quillrec.functions import mlkem

#: The envelope and key formats (fixed values).
ENVELOPE_MAGIC, PUBLIC_MAGIC, SECRET_MAGIC = b"M2CM5ENC", b"M2CM5PUB", b"M2CM5SEC"
VERSION, SUITE, ALGORITHM = 1, 1, 1
FRAME, TAG, MOST_FRAMES = 1 << 20, 16, 1 << 32
MOST_PLAIN = FRAME * MOST_FRAMES
INFO = b"M2C-M5-SUITE-0001-CONTENT-KEY"
_HEAD = struct.Struct(">8sHHQ32s32s7s1088s")
_KEY = struct.Struct(">8sHHI")
STAGING = ".quillrec-staging-"
HEADER = _HEAD.size


@dataclass(frozen=True)
class Header:
    plain_bytes: int
    fingerprint: bytes
    salt: bytes
    nonce_prefix: bytes
    ciphertext: bytes

    def encode(self) -> bytes:
        return _HEAD.pack(ENVELOPE_MAGIC, VERSION, SUITE, self.plain_bytes, self.fingerprint, self.salt, self.nonce_prefix, self.ciphertext)


def decode_header(data: bytes) -> Header:
    if len(data) < HEADER:
        raise ProtectionError("InvalidLength", artifact="M5 envelope", expected=HEADER, actual=len(data))
    magic, version, suite, *rest = _HEAD.unpack_from(data)
    if magic != ENVELOPE_MAGIC:
        raise ProtectionError("InvalidMagic", artifact="M5 envelope")
    if version != VERSION:
        raise ProtectionError("UnsupportedVersion", artifact="M5 envelope", version=version)
    if suite != SUITE:
        raise ProtectionError("UnsupportedSuite", suite=suite)
    header = Header(*rest)
    frame_count(header.plain_bytes)
    return header


def frame_count(plain_bytes: int) -> int:
    """One frame for an empty file, else one for each MiB begun."""
    if plain_bytes > MOST_PLAIN:
        raise ProtectionError("InputTooLarge", length=plain_bytes, maximum=MOST_PLAIN)
    return max(1, -(-plain_bytes // FRAME))


def envelope_size(plain_bytes: int) -> int:
    return HEADER + plain_bytes + TAG * frame_count(plain_bytes)


def encode_key(payload: bytes, secret: bool) -> bytes:
    size = mlkem.SECRET_BYTES if secret else mlkem.PUBLIC_BYTES
    if len(payload) != size:
        raise ProtectionError("InvalidLength", artifact="M5 key payload", expected=size, actual=len(payload))
    return _KEY.pack(SECRET_MAGIC if secret else PUBLIC_MAGIC, VERSION, ALGORITHM, size) + payload


def decode_key(data: bytes, secret: bool) -> bytes:
    size, name = (mlkem.SECRET_BYTES, "M5 secret key") if secret else (mlkem.PUBLIC_BYTES, "M5 public key")
    if len(data) != _KEY.size + size:
        raise ProtectionError("InvalidLength", artifact=name, expected=_KEY.size + size, actual=len(data))
    magic, version, algorithm, declared = _KEY.unpack_from(data)
    if magic != (SECRET_MAGIC if secret else PUBLIC_MAGIC):
        raise ProtectionError("InvalidMagic", artifact=name)
    if version != VERSION:
        raise ProtectionError("UnsupportedVersion", artifact=name, version=version)
    if algorithm != ALGORITHM:
        raise ProtectionError("UnsupportedAlgorithm", algorithm=algorithm)
    if declared != size:
        raise ProtectionError("InvalidLength", artifact="declared M5 key payload", expected=size, actual=declared)
    return data[_KEY.size :]


def content_key(shared: bytes, salt: bytes) -> bytes:
    """HKDF-SHA-256 with one block of output."""
    extracted = hmac.digest(salt, shared, "sha256")
    return hmac.digest(extracted, INFO + b"\x01", "sha256")


def nonce(prefix: bytes, index: int, last: bool) -> bytes:
    return prefix + index.to_bytes(4, "big") + bytes([last])


# ---------------------------------------------------------------- destinations


def _unsafe(path: Path, reason: str) -> ProtectionError:
    return ProtectionError("UnsafePath", path=path, reason=reason)


def _control(path: Path) -> dict:
    with open(path, "rb") as f:
        data = f.read(4097)
    if len(data) > 4096:
        raise _unsafe(path, "possible M4 control file exceeds its bounded classification size")
    try:
        found = json.loads(data)
    except ValueError as e:
        raise _unsafe(path, "possible M4 control file cannot be classified safely") from e
    if not isinstance(found, dict):
        raise _unsafe(path, "possible M4 control file is not an object")
    return found


def job_root(folder: Path) -> Path | None:
    """The nearest folder at or above ``folder`` that looks like a recoverable job."""
    from quillrec.sources.parts import COMMITS, COMPLETE, FORMAT, LOCK, MANIFEST, PARTS, PROFILE

    for d in (folder, *folder.parents):
        if any(os.path.lexists(d / n) for n in (LOCK, f".{MANIFEST}.tmp", f".{COMPLETE}.tmp")):
            return d
        manifest, complete = d / MANIFEST, d / COMPLETE
        control = [p for p in (manifest, complete) if os.path.lexists(p)]
        if control and (d / PARTS).is_dir() and (d / COMMITS).is_dir():
            return d
        for p in control:
            found = _control(p)
            ours = found.get("format") == FORMAT or found.get("version") == 1 and found.get("profile") == PROFILE
            if ours if p == manifest else found.get("version") == 1:
                return d
    return None


def checked_destination(path) -> Path:
    """An absolute path that may be created: no way up, no links above it, a parent that exists, no job's folder, not there yet."""
    path = Path(path)
    if ".." in path.parts:
        raise _unsafe(path, "parent-directory components are not allowed")
    full = Path(os.getcwd()) / path
    if ":" in full.name or full.name.endswith((".", " ")) or not full.name or full.name.startswith(STAGING):
        raise _unsafe(path, "file name is reserved or not portable")
    for above in full.parents:
        try:
            mode = os.lstat(above).st_mode
        except FileNotFoundError as e:
            raise _unsafe(above, "output ancestor does not exist") from e
        if stat.S_ISLNK(mode):
            raise _unsafe(above, "reparse points and symlinks are not allowed in output paths")
    if root := job_root(full.parent):
        raise ProtectionError("DestinationInM4Namespace", path=full, root=root)
    if os.path.lexists(full):
        raise ProtectionError("OutputAlreadyExists", path=full)
    return full


@contextmanager
def staged(path, secret: bool, warnings: list[str]) -> Iterator[Path]:
    """A new file beside ``path``; it takes that name, never over another, if the block ends well. Else it is removed."""
    full = checked_destination(path)
    mode = 0o600 if secret else 0o644
    for _ in range(32):
        temporary = full.parent / (STAGING + secrets.token_hex(16))
        try:
            os.close(os.open(temporary, os.O_CREAT | os.O_EXCL | os.O_WRONLY, mode))
            break
        except FileExistsError:
            continue
    else:
        raise _unsafe(full, "no staging name is free")
    try:
        try:
            os.chmod(temporary, mode)
        except OSError:
            warnings.append("permission_restriction_failed")
        yield temporary
        with open(temporary, "rb+") as f:
            os.fsync(f.fileno())
        checked_destination(full)
        try:
            os.link(temporary, full)
        except FileExistsError as e:
            raise ProtectionError("OutputAlreadyExists", path=full) from e
    finally:
        try:
            os.unlink(temporary)
        except OSError:
            warnings.append("staging_residue")


# ---------------------------------------------------------------- operations


def _read(path, operation: str, limit: int) -> bytes:
    try:
        with open(path, "rb") as f:
            if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
                raise _unsafe(path, "not a regular file")
            return f.read(limit)
    except OSError as e:
        raise ProtectionError("Io", operation=operation, path=path, source=e) from e


def _size(path, operation: str) -> int:
    try:
        found = os.stat(path)
    except OSError as e:
        raise ProtectionError("Io", operation=operation, path=path, source=e) from e
    if not stat.S_ISREG(found.st_mode):
        raise _unsafe(path, "not a regular file")
    return found.st_size


def _public_key(path) -> bytes:
    payload = decode_key(_read(path, "open public key", _KEY.size + mlkem.PUBLIC_BYTES + 1), secret=False)
    if not mlkem.valid_public(payload):
        raise ProtectionError("InvalidKey", path=path, reason="public key failed its modulus check")
    return payload


def _secret_key(path) -> bytes:
    payload = decode_key(_read(path, "open secret key", _KEY.size + mlkem.SECRET_BYTES + 1), secret=True)
    if not mlkem.valid_secret(payload):
        raise ProtectionError("InvalidKey", path=path, reason="secret key failed its integrity check")
    return payload


def _frames(spark: SparkSession, source, target: Path, header: Header, key: bytes, seal: bool) -> None:
    """Seals or opens all frames from ``source`` into their places in ``target``."""
    aad, count, plain = header.encode(), frame_count(header.plain_bytes), header.plain_bytes
    source, target, prefix = os.path.abspath(source), os.fspath(target), header.nonce_prefix
    from_step, to_step = (FRAME, FRAME + TAG) if seal else (FRAME + TAG, FRAME)
    from_start, to_start = (0, HEADER) if seal else (HEADER, 0)
    extra = 0 if seal else TAG

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(source, "rb") as f:
            for pdf in batches:
                for i in pdf["id"]:
                    f.seek(from_start + i * from_step)
                    size = min(FRAME, plain - i * FRAME) + extra
                    data = f.read(size)
                    if len(data) != size:
                        raise ValueError("input changed during the operation")
                    yield pd.DataFrame({"id": [i], "iv": [nonce(prefix, int(i), i == count - 1)], "data": [data]})

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(target, "rb+") as f:
            for pdf in batches:
                for i, data in zip(pdf["id"], pdf["out"], strict=True):
                    f.seek(to_start + i * to_step)
                    f.write(data)
                yield pd.DataFrame({"n": [len(pdf)]})
            f.flush()
            os.fsync(f.fileno())

    # a few frames in a partition, and one in a batch: a task holds some MiB
    frames = spark.range(0, count, 1, max(1, -(-count // 8))).mapInPandas(load, "id long, iv binary, data binary")
    lit = lambda b: F.lit(bytearray(b))
    if seal:  # Spark puts the nonce in front; the envelope does without
        out = F.substring(F.aes_encrypt("data", lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col("iv"), lit(aad)), 13, FRAME + TAG)
    else:
        out = F.aes_decrypt(F.concat("iv", "data"), lit(key), F.lit("GCM"), F.lit("DEFAULT"), lit(aad))
    done = frames.select("id", out.alias("out")).mapInPandas(save, "n long").agg(F.sum("n")).first()[0]
    if done != count:
        raise ProtectionError("InvalidLength", artifact="M5 frame sequence", expected=count, actual=done)


def generate_keypair(output_dir) -> dict:
    """Writes public.key and secret.key into an existing folder; the public one first, so a failure may leave it alone."""
    warnings: list[str] = []
    public, secret = mlkem.generate()
    for name, payload, hidden in (("public.key", public, False), ("secret.key", secret, True)):
        with staged(Path(output_dir) / name, hidden, warnings) as path:
            path.write_bytes(encode_key(payload, hidden))
    return {"public_key": "published", "secret_key": "published", "warnings": warnings}


def protect_file(spark: SparkSession, input_path, public_key_path, output_path) -> dict:
    """Seals a file for the holder of a secret key into a new envelope."""
    warnings: list[str] = []
    plain = _size(input_path, "open input")
    size = envelope_size(plain)
    public = _public_key(public_key_path)
    shared, ciphertext = mlkem.encapsulate(public)
    header = Header(plain, hashlib.sha256(public).digest(), secrets.token_bytes(32), secrets.token_bytes(7), ciphertext)
    with staged(output_path, False, warnings) as path:
        with open(path, "rb+") as f:
            f.write(header.encode())
            f.truncate(size)
        _frames(spark, input_path, path, header, content_key(shared, header.salt), seal=True)
        if os.stat(input_path).st_size != plain:
            raise ProtectionError("InvalidLength", artifact="M5 input", expected=plain, actual=os.stat(input_path).st_size)
    return {"output": "published", "warnings": warnings}


def unprotect_file(spark: SparkSession, input_path, secret_key_path, output_path) -> dict:
    """Opens an envelope into a new file. Nothing is published unless every frame is authentic."""
    warnings: list[str] = []
    size = _size(input_path, "open envelope")
    header = decode_header(_read(input_path, "open envelope", HEADER))
    if size != envelope_size(header.plain_bytes):
        raise ProtectionError("InvalidLength", artifact="M5 envelope", expected=envelope_size(header.plain_bytes), actual=size)
    secret = _secret_key(secret_key_path)
    public = secret[384 * mlkem.K : 384 * mlkem.K + mlkem.PUBLIC_BYTES]
    if not hmac.compare_digest(hashlib.sha256(public).digest(), header.fingerprint):
        raise ProtectionError("RecipientFingerprintMismatch")
    shared = mlkem.decapsulate(secret, header.ciphertext)
    with staged(output_path, False, warnings) as path:
        os.truncate(path, header.plain_bytes)
        try:
            _frames(spark, input_path, path, header, content_key(shared, header.salt), seal=False)
        except Exception as e:
            if isinstance(e, ProtectionError) or not re.search("AES|Tag mismatch|DECRYPT|BadTag", str(e)):
                raise
            raise ProtectionError("AuthenticationFailed") from e
    return {"output": "published", "warnings": warnings}


def residue(folder) -> list[Path]:
    """Staging files that a killed run has left."""
    with suppress(OSError):
        return sorted(p for p in Path(folder).iterdir() if p.name.startswith(STAGING))
    return []
