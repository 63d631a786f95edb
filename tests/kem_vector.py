"""An interoperability vector for ML-KEM-768 and the envelope, made with OpenSSL and another AES-GCM (fixed values)."""

SEED = (
    "88b85e2903ee72a79021b8f64c19c904018347d8482bbea3434a36fe36d6f9d7be41f0a9651af46513cdc882fe0ce277a7ff3c7745b97d500c615d5b87c4568e"
)
PUBLIC_SHA256 = "4f3ad7962254518b554e6e4ba082bd00355af79260b45503c4f411c43bd4348c"
SHARED = "87cb73afa8e60e1aaa90d198fbcc7537da8ae36033b5928bf5ddbb80022323c7"
CIPHERTEXT = (
    "08bf889e47d2dffd6211cd8139e1de3d21abf8a5993722cfa8b85668d80737c8829e1b4fed4d2943040b64d6e049f595b6f027c9214e87e9ecea945d33d85e5e"
    "361e594ee331ba3be0f527b378758106430c9716133408d5cd7c2d787cb6adc32c0ecdfa49e55235d40153ec6f575a3dfaa88bf8f9b0a7454cdada15a85fa3bc"
    "e1b1be8b62f20b03b0685ceb9788c23b7613957733330367eb846e47c66e6e3e8bf05f8cb21260a1adec1a380807e086f1b4259357c41b1f7f891169f9fc1747"
    "abf4ce4a49adf8c9ff2caa3e91e2e3c2dd5a915d07fc96785fd88d73334b87b752e8504d31c0ea660044134955d28623ad5da4c0016082c549b4ac931b032ed4"
    "ba9474cc0dac3bbab97860aad3b6bb2117b612729bcea92e5bc28c8e76351ccce9b51ffd8a652362fc2653a5280c1c5291758f19a93fb3c23894301be2664ef1"
    "b7a0ff1a06731e3866703023b82b0670b686b3a48a10797a5a6e07e87aeb6d1095e1072b11d830b396c974e97b66484c04811bfb2365fe904d6a4a4438d68cf1"
    "0bb26dee2e64d94a997c018798708472608dc6e2fb6ea0f4dbe5efbf98024386389d4fd7dbf52bbaf58e3cebe7ff9bda8c2b2b942512b7338299cae8919b67c2"
    "f872277890a05dbf5439b0de307e34241b4d1e30abfc11ffac6f45a292ad74f0031d430af31678c78afb37cf7911ec60880caec38942926f471525839cfe6807"
    "250ae0152b39671e8c03f591cee897505bad4454c58990f43b5d8bfd4571a9babedba9375aa0d33b222da5068b5191ef2e185c19614bca323aa4d5434197ed10"
    "c0f2e5600f000f5e267483541935dccf1ff4b5de634d50c95d3564a3f21ede3f9b85982511f83f3ef51eac98afffcfdc54621b3a83e0ff973ef50b5b3bd9b661"
    "112ec8e4222241408845bfaf9943c3c633be8c9eb3cec458e1c996b9124a72bce31a83d440cf607817ac52bc842093942609adcc3f6e0d815cf436eb2c39065e"
    "230d208905fc479729a53d816bf12d0da63eeee0960e0ed7e6318c35c72154319e907ea899090c07c493983033fa9060efb6d1d5049dff8d6d6914b1157a7edf"
    "29c9c22a97bde2e6e8ef5b2487f06c69b5acf88f4d9ba8e5377c041523572215491f41d45af45b004d3531b4071c8553bdf2c9cd31e444ffab0de4dcddc4286e"
    "f32d8dc32a9dd7d09e17e545ea77d3858ff126976545fcc9b9471392fe4e19b60c59f7d9fc14f11caa492b5f8c9f98039e8f4d1f0e245646ccd434b2c34b89e6"
    "2adecbd2aebedb825484f01a1457e5d611e737b2a39a8c45a20579b1009d54ea723c431456d1677e19e913d982b8891e61e35692f87b05f28b862e40b66348a0"
    "abbcc6bb7c07240eb1d2d866a28fd1c93332eeebb7f71a3cafd5d02a829487e2ff3a42ada16248455370511999e79ee49300346406e19300989bc694fb0677fa"
    "b2fa2f1fe2708760fe87c2378f42eb95d7e4e8dd301dd3e64ab44e151db6674407f77bc9f3b67a82adef1620d2d69a3db4d436ae4aefb26acf6657594a3ecc9a"
)
SALT, NONCE_PREFIX = bytes(range(32)), bytes(range(0xA0, 0xA7))
PLAINTEXT = b'independent M5 envelope fixture\n'
FRAME = "d7fee28a65e7a9274d45bcc215ffb50f801722d382c6f209864ad49b2385a8e51bb382942c8fed564a12592174ca7e0d"
