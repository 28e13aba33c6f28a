"""Column functions on addresses, ports, protocols and TCP flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Port groups, protocol codes, TCP flag bits.
PORT_GROUPS = {
    "web": (80, 443, 8080, 8443),
    "dns_time": (53, 123),
    "remote": (22, 3389),
    "mail": (25, 110, 143),
    "mail_secure": (587, 993, 995),
    "databases": (3306, 5432, 27017),
}
PROTOCOL_CODES = {"TCP": 1, "UDP": 2, "ICMP": 3}
FLAG_BITS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16}

# Addresses that are private, loopback, link-local or reserved.
SPECIAL_IPV4 = "|".join(
    (
        r"(0|10|127)\..*", r"169\.254\..*", r"172\.(1[6-9]|2[0-9]|3[01])\..*",
        r"192\.0\.0\.(?!(9|10)$).*", r"192\.0\.2\..*", r"192\.168\..*", r"198\.1[89]\..*",
        r"198\.51\.100\..*", r"203\.0\.113\..*", r"(24[0-9]|25[0-5])\..*",
    )
)
PUBLIC_IPV6 = "|".join(
    (
        r"(?!200[12]:)[23][0-9a-f]{3}:.*", r"2001:(?!(0?[01]?[0-9a-f]{0,2}|0?db8)(:|$)).*",
        r"fe[c-f][0-9a-f]:.*", r"ff[0-9a-f]{2}:.*",
    )
)

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_IPV6 = (
    r"^(?!.*:::)(?!.*::.*::)(?=.*::|([^:]*:){7}|([^:]*:){6}([0-9]+\.){3}[0-9]+$)(?!([^:]*:){9})"
    r"(?!(?!::)(?!.*::$)([^:]*:){8})"
    r"([0-9a-f]{0,4}:)+([0-9a-f]{0,4}|([0-9]{1,3}\.){3}[0-9]{1,3})$"
)


def ipv4_number(address: Column) -> Column:
    """Dotted IPv4 as a number, NULL when it is not one."""
    parts = F.split(address, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(address.rlike(_IPV4), number)


def is_private(address: Column) -> Column:
    """Private, loopback, link-local or reserved; anything unparsable is not."""
    text = F.lower(F.trim(address))
    special = F.when(text.contains(":"), text.rlike(_IPV6) & ~text.rlike(f"^({PUBLIC_IPV6})$"))
    return F.coalesce(
        special.otherwise(text.rlike(_IPV4) & text.rlike(f"^({SPECIAL_IPV4})$")), F.lit(False)
    )


def protocol_code(name: Column) -> Column:
    """F8: TCP 1, UDP 2, ICMP 3, anything else 0."""
    code = F.lit(0)
    for label, value in PROTOCOL_CODES.items():
        code = F.when(F.upper(name) == label, value).otherwise(code)
    return code


def protocol_name(code: Column) -> Column:
    """F8, the other direction."""
    name = F.lit("OTHER")
    for label, value in PROTOCOL_CODES.items():
        name = F.when(code == value, label).otherwise(name)
    return name


def port_category(port: Column) -> Column:
    """group of a known port, 'unknown' for others, NULL for no port."""
    group = F.lit("unknown")
    for label, ports in PORT_GROUPS.items():
        group = F.when(port.isin(*ports), label).otherwise(group)
    return F.when(port.isNotNull() & (port != 0), group)


def unusual_port(port: Column) -> Column:
    """the port itself when it is unknown and above the well-known range."""
    return F.when((port_category(port) == "unknown") & (port > 1024), port)


def is_https(protocol: Column, port: Column) -> Column:
    """F11."""
    return F.coalesce((F.upper(protocol) == "TCP") & (port == 443), F.lit(False))


def flag_bit(flags: Column, letter: str) -> Column:
    """1 when a flag is set; ``flags`` is letters ("SA") or the header number."""
    as_number = flags.try_cast("int")
    return (
        F.when(as_number.isNotNull(), (as_number.bitwiseAND(FLAG_BITS[letter]) > 0).cast("int"))
        .otherwise(F.coalesce(F.upper(flags).contains(letter).cast("int"), F.lit(0)))
    )
