"""Tables, raw lines, rendered lines, catalogues and dimensions."""
