"""Planning on the driver: mappings between schemas, and what they compile to."""
