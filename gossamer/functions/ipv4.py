"""IPv4 ranges as numbers."""

from __future__ import annotations

# fixed values: IPv4 ranges that aren't public
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)


def ranges() -> list[tuple[int, int]]:
    """The first and last address of each range that isn't public."""
    out = []
    for cidr in NOT_GLOBAL:
        at, bits = cidr.split("/")
        low = 0
        for x in at.split("."):
            low = low * 256 + int(x)
        out.append((low, low + 2 ** (32 - int(bits)) - 1))
    return out
