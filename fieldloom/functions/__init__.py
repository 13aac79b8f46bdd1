"""Part of fieldloom; see the modules inside."""
