"""Job plans and the pipeline text language."""
