"""Pieces of SQL that several queries share."""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII string; eight shifts for every character."""
    shifts = ("list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], "
              "lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))")
    steps = f"list_transform([xor(c, u)], lambda b: {shifts})[1]"
    codes = (f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))")
    return f"xor(4294967295, list_reduce({codes}, lambda c, u: {steps}, 4294967295))"
