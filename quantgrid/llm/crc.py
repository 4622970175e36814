"""CRC-32 in DuckDB SQL, for the queries whose contract deals by it."""

from __future__ import annotations

#: A common table with the 256 remainders of one byte; 3988292384 is the reversed polynomial.
CRC_SQL = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::ubigint, [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_sql(text: str, table: str = "t") -> str:
    """The unsigned crc32 of the UTF-8 bytes of the SQL expression ``text``; ``table`` names the column of the common table."""
    octets = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::int::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint)"
