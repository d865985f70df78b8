"""Pieces of SQL that several queries share."""

POLYNOMIAL = 0xEDB88320


def _nibbles() -> list[int]:
    out = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (POLYNOMIAL if n & 1 else 0)
        out.append(n)
    return out


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, by half bytes, the lower one first."""
    table = ", ".join(f"{n}::BIGINT" for n in _nibbles())
    digits = f"list_transform(generate_series(0, CAST(length(hex({text})) AS BIGINT) - 1), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex({text}), CAST(i + 1 + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS BIGINT), 1)) - 1 AS BIGINT))"
    step = f"lambda a, x: xor(a >> 4, [{table}][CAST((xor(a, x) & 15) + 1 AS BIGINT)])"
    return f"xor(list_reduce({digits}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
