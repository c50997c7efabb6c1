"""The declared dimensions of the registered queries."""

from __future__ import annotations

from ..operators.conformance import load_policy
from ..operators.trusted import Writer

OT = ("10.10.0.0/16", "10.20.0.0/16")
POLICY = load_policy(
    {
        "zones": [
            {"id": "z_eng", "level": "L3", "members": ["10.10.0.0/24"]},
            {"id": "z_hmi", "level": "L2", "members": ["10.10.0.0/22"]},
            {"id": "z_dmz", "level": "IDMZ", "members": ["10.10.4.0/23"]},
            {"id": "z_it", "level": "L4", "members": ["10.10.6.0/23"]},
            {"id": "z_plc", "level": "L1", "members": ["10.20.0.0/23"]},
            {"id": "z_hist", "level": "L3", "members": ["10.20.2.0/23"]},
        ],
        "conduits": [
            {"from": "z_hmi", "to": "z_plc", "direction": "forward", "proto": "tcp", "ports": ["502", "44818"]},
            {"from": "z_eng", "to": "z_plc", "direction": "bidirectional", "proto": "tcp", "ports": ["102", "502", "20000-20010"]},
            {"from": "z_it", "to": "z_dmz", "direction": "bidirectional", "proto": "tcp", "ports": "any"},
            {"from": "z_dmz", "to": "z_hist", "direction": "forward", "proto": "tcp", "ports": ["389", "443"]},
            {"from": "z_hist", "to": "z_hmi", "direction": "forward", "proto": "tcp", "ports": ["5938"]},
            {"from": "z_it", "to": "z_hist", "direction": "forward", "proto": "udp", "ports": ["161"]},
        ],
    }
)
TRUSTED = [Writer.parse(t) for t in ("10.10.0.0/24=10.20.0.0/16:any", "10.10.1.0/24=10.20.0.0/16:modbus", "10.99.0.1=10.99.0.2:s7")]
#: Packets before this time are the base capture of the drift queries.
SPLIT = "1995-06-17 00:00:00"
