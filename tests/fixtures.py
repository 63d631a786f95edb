"""The golden layout and its three records (fixed values), and small helpers."""

import hashlib

COPYBOOK = (
    "000100 01  SAMPLE-RECORD.\n"
    "000200     05  HEADER-GROUP.\n"
    "      * names are padded\n"
    "000300         10  CUSTOMER-NAME     PIC X(10).\n"
    "000400         10  FILLER            PIC X(2).\n"
    "000500         10  ACCOUNT-NUMBER    PIC 9(4) DISPLAY.\n"
    "000600         10  INTEREST-RATE     PIC 9(5)V9(2) DISPLAY.\n"
    "000700         10  BALANCE-BIN       PIC S9(4) COMP.\n"
    "000800         10  RATE-BIN          PIC 9(5)V9(2) BINARY.\n"
    "000900         10  AMOUNT-PACKED     PIC S9(7)V9(2) COMP-3.\n"
    "001000         10  FILLER            PIC X.\n"
)
GROUP = "SAMPLE-RECORD.HEADER-GROUP"
RECORDS = bytes.fromhex(
    "C1D3C9C3C54040404040 00FF F0F0F4F2 F0F0F1F2F3F4F5 FF85 0001E240 123456789C AA"
    "D196A251404040404040 ABCD F9F9F9F9 F9F9F9F9F9F9F9 270F 0098967F 000000123D 00"
    "0015259FBABB40404040 0102 F0F0F0F0 F0F0F0F0F0F0F0 0000 00000000 000000000D FF"
)
assert hashlib.sha256(RECORDS).hexdigest() == "bc5083614c9c50322a78ea30b909fabb28d63a22f0d4bda87f77dfd49e47fb73"
ROWS = [
    ("ALICE     ", 42, "123.45", -123, "1234.56", "1234567.89"),
    ("José      ", 9999, "99999.99", 9999, "99999.99", "-1.23"),
    ("\0\x85\n¤[]    ", 0, "0.00", 0, "0.00", "0.00"),
]


def plain(rows):
    return [tuple(v if isinstance(v, (str, int)) or v is None else str(v) for v in r) for r in rows]


def copybook(*entries):
    return "".join(f"       {e}\n" for e in ("01 REC.", *(f"05 {e}" for e in entries)))
