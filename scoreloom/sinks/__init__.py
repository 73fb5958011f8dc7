"""Writers and nested reports."""
