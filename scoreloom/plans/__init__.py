"""Registered queries over the shared test tables, with the SQL that checks them."""
