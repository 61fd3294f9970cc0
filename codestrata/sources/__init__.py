"""Sources and sinks: archives, folders, encoded bytes, files tables and report documents."""
