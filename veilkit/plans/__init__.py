"""Reports over the audit table and end-to-end jobs composed from the operators."""
