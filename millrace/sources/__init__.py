"""Sources and sinks: frames, filesets, sequences, parameter and matrix files."""
