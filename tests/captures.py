"""Synthetic captures for the tests."""

import struct


def element(number, payload):
    return bytes([number, len(payload)]) + payload


def frame(mac, elements, subtype=4, seq=33, freq=2437, fcs=b"\x01\x02\x03\x04"):
    radiotap = struct.pack("<BBHIHH", 0, 0, 12, 1 << 3, freq, 0xA0)
    header = bytes([subtype << 4, 0, 0, 0]) + b"\xff" * 6 + bytes.fromhex(mac.replace(":", "")) + b"\xff" * 6 + struct.pack("<H", seq)
    return radiotap + header + b"".join(elements) + fcs


def pcap(frames, order="<", nano=False, link=127):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, (500000 + i) * (1000 if nano else 1), len(f), len(f)) + f
    return out


def pcapng(frames, link=127):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", link, 0, 65535))
    for i, f in enumerate(frames):
        when = (1000 + i) * 1_000_000 + 500000 + i
        out += block(6, struct.pack("<IIIII", 0, when >> 32, when & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


RATES = element(1, bytes([2, 4, 11, 22]))
DS = element(3, b"\x06")
HT = element(45, bytes([0x2D, 0x40, 0x1B, 0xFF]) + bytes(22))
EXT = element(127, bytes([0x04, 0x00, 0x08, 0x80]))
VENDOR_A, VENDOR_B = element(221, bytes.fromhex("0050f208")), element(221, bytes.fromhex("001018"))
ALL = [element(0, b"net"), RATES, DS, HT, EXT, VENDOR_A, VENDOR_B, element(255, bytes([35, 1, 2]))]
