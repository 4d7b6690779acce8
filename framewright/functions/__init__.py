"""Column expressions: bytes and bits, hex sums, fingerprints, distances."""

from framewright.functions.bits import (
    ascii_sum,
    bit_text,
    bytes_to_hex,
    freq_to_channel,
    frequency_to_channel,
    hex_to_binary,
    pad_array,
    u_to_zero,
)
from framewright.functions.distances import (
    bit_fingerprint,
    char_fingerprint,
    hamming,
    hamming_text,
    manhattan,
    prefix,
    weighted_hamming,
)

__all__ = [
    "ascii_sum",
    "bit_fingerprint",
    "bit_text",
    "bytes_to_hex",
    "char_fingerprint",
    "freq_to_channel",
    "frequency_to_channel",
    "hamming",
    "hamming_text",
    "hex_to_binary",
    "manhattan",
    "pad_array",
    "prefix",
    "u_to_zero",
    "weighted_hamming",
]
