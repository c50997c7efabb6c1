import ipaddress
import random

from plantflow.operators.trusted import UNROLLED, Writer, match_trusted


def test_long_lists_match_like_one_by_one(spark):
    """All lengths, nested and repeated declarations, both families, one source with a third of the rows, and nulls."""
    rng = random.Random(8)

    def network(text):
        address = ipaddress.ip_address(text)
        return str(ipaddress.ip_network((text, rng.choice([rng.randint(0, address.max_prefixlen), *[rng.randint(address.max_prefixlen - 8, address.max_prefixlen)] * 4])), strict=False))

    def address():
        if rng.random() < 0.3:
            return "2001:db8::" + format(rng.choice([1, 2, 0x1F, 0x8000]), "x")
        return rng.choice(["10.1.2.3", f"10.1.{rng.randint(0, 3)}.{rng.randint(0, 255)}"])

    rules = [Writer(network(address()), network(address()), rng.choice(["modbus", "s7", "cip", "dnp3", "any"])) for _ in range(200)]
    assert len(rules) > UNROLLED
    rules = [r for r in rules if not (r.src.endswith("/0") and r.dst.endswith("/0"))]
    rows = [(k, address(), address(), rng.choice(["modbus", "s7", "cip", "dnp3", "other"])) for k in range(400)]
    rows += [(500 + k, "10.1.2.3", address(), "s7") for k in range(200)] + [(900, None, "10.1.2.3", "s7"), (901, "10.1.2.3", "10.1.2.3", None)]
    got = {r.id: r.rule for r in match_trusted(spark.createDataFrame(rows, "id int, src_ip string, dst_ip string, proto_name string"), rules).collect()}
    nets = [(ipaddress.ip_network(r.src), ipaddress.ip_network(r.dst), r.proto) for r in rules]
    inside = lambda ip, n: ip is not None and ipaddress.ip_address(ip) in n
    first = lambda s, d, p: next((k for k, (a, b, q) in enumerate(nets, 1) if inside(s, a) and inside(d, b) and q in ("any", p)), None)
    want = {k: first(s, d, p) for k, s, d, p in rows if k != 901}
    assert {k: v for k, v in got.items() if k != 901} == want and len(got) == len(rows)
    assert len(set(want.values())) > 20
    few = rules[:UNROLLED]
    short = {r.id: r.rule for r in match_trusted(spark.createDataFrame(rows, "id int, src_ip string, dst_ip string, proto_name string"), few).collect()}
    assert all(short[k] == (v if v and v <= UNROLLED else None) for k, v in want.items())
