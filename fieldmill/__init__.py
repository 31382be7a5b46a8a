"""fieldmill: scoring, distillation tables and sampling for structured extraction, on PySpark."""
