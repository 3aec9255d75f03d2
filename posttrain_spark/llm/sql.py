"""Parts of SQL twins that several operators share."""


def crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda a, x: {step}), 4294967295::BIGINT)"
