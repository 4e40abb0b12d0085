"""Set-based operators over canonical agent events; each is DataFrame in, lazy DataFrame out."""
