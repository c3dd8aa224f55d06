"""Tables, binary log files and reply encodings."""
