"""Registered queries and the DuckDB SQL that checks them."""

from catalog import bodies, decisions, masking, reports, scan, state, streams, usage

MODULES = [usage, reports, scan, masking, decisions, bodies, state, streams]
