"""Registered queries over the driver tables, each with its equivalent SQL where there is one."""
